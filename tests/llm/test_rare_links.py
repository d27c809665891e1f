"""Rare links among many vectors: the audit must see them."""

import numpy as np
import pytest

from hedgewatch.llm import neighbours


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_pairs_among_strangers(spark, seed, monkeypatch):
    """Pairs just above the threshold in many unrelated vectors: a sample of a few hundred holds none of them."""
    monkeypatch.setattr(neighbours, "AUDITED", (256, 2048, 16_384))
    draw = np.random.default_rng(seed)
    rows = draw.standard_normal((12_000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for p in range(24):
        other = draw.standard_normal(64)
        other -= other @ rows[p] * rows[p]
        rows[6000 + p] = 0.905 * rows[p] + np.sqrt(1 - 0.905 ** 2) * other / np.linalg.norm(other)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = neighbours.near_duplicates(df).where("n_links > 0 OR NOT kept").collect()
    assert {(r["vec_id"], r["component_id"], r["n_links"]) for r in found} == {(i, p, 1) for p in range(24) for i in (p, 6000 + p)}


def test_audit_measures_lost_links(spark):
    """Half of the links are held back: the audited recall says so."""
    draw = np.random.default_rng(5)
    base = draw.standard_normal((400, 16))
    rows = np.concatenate([base, base + 0.01 * draw.standard_normal(base.shape)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    nodes = neighbours.usable_vectors(df).selectExpr("vec_id AS id", "raw", "1L AS copies")
    audit = neighbours.Audit(nodes, 0.9, sizes=(100, 300, 600))
    assert not audit.complete and len(audit.true) >= 200
    links = spark.createDataFrame([(i + side * 400, 1) for i in range(0, 400, 2) for side in (0, 1)], "id long, links long")
    assert abs(audit.recall(links) - 0.5) < 0.1
    assert audit.recall(spark.range(800).selectExpr("id", "1L AS links")) == 1.0
    met = {(r["a"], r["b"]) for r in audit.links.collect()}
    assert all(b == a + 400 for a, b in met) and len(met) >= 200
