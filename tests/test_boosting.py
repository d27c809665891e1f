import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.operators import boosting

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.IntegerType()),
                    T.StructField("weight", T.DoubleType())])


def sparse_rows(spark, n, features, filled):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        own = sorted(rng.sample(range(features), rng.randint(0, filled)))
        values = [rng.choice([0.25, 0.5, rng.random()]) for _ in own]
        given = dict(zip(own, values))
        label = int(given.get(1, 0) > 0.3 or given.get(4, 0) + given.get(2, 0) > 0.9 or rng.random() < 0.1)
        rows.append((i, Vectors.sparse(features, own, values), label, 0.7 if label else 1.9))
    return spark.createDataFrame(rows, ROW).repartition(3)


def probabilities(model, rows):
    return {r["id"]: r["p"] for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.mark.parametrize("sums, write", [(16_000_000, 20), (300, 2)])
def test_trees_are_those_of_sparks_own_learner(spark, monkeypatch, sums, write):
    monkeypatch.setattr(boosting, "SUMS", sums)
    monkeypatch.setattr(boosting, "WRITE_MARGINS", write)
    rows = sparse_rows(spark, 600, 12, 7).localCheckpoint()
    model = boosting.fit(rows, 12, 4, 0.3, 4, 42)
    other = GBTClassifier(weightCol="weight", maxIter=4, stepSize=0.3, maxDepth=4, seed=42).fit(rows)
    got, expected = probabilities(model, rows), probabilities(other, rows)
    assert max(abs(got[i] - expected[i]) for i in expected) < 1e-9 and len(got) == 600
    assert len(set(expected.values())) > 10


def test_a_row_costs_what_it_holds_not_what_the_vocabulary_holds(spark):
    """400,000 terms of which a row has at most 7: one integer per row and term would be 960 MB."""
    rows = sparse_rows(spark, 600, 12, 7).localCheckpoint()
    wide = rows.withColumn("features", F.udf(lambda v: Vectors.sparse(400_000, v.indices * 33_000, v.values), VectorUDT())("features")).localCheckpoint()
    narrow, spread = (boosting.fit(r, n, 2, 0.3, 3, 42) for r, n in ((rows, 12), (wide, 400_000)))
    a, b = probabilities(narrow, rows), probabilities(spread, wide)
    assert a == pytest.approx(b, abs=1e-12)


def test_rows_without_a_feature(spark):
    rows = spark.createDataFrame([(i, Vectors.sparse(3, [], []), int(i < 3), 1.0) for i in range(4)], ROW)
    model = boosting.fit(rows, 3, 3, 0.1, 2, 42)
    assert 0.7 < probabilities(model, rows)[0] < 1.0


def test_thresholds_keep_to_the_number_of_bins():
    values = np.arange(1.0, 101.0)
    found = boosting._at_thresholds(values, np.ones(100), 200.0, 100)
    assert len(found) <= boosting.MAX_BINS - 1 and found[0] == 0.5 and found == sorted(found)
    assert boosting._at_thresholds(np.array([2.0]), np.array([4.0]), 4.0, 4) == []


def test_equal_lists_of_rows_are_kept_once():
    rows, first = np.array([0, 2, 5, 1, 0, 2, 5, 1, 3, 3], np.uint16), np.array([0, 3, 4, 7, 8, 9])
    number, ends, kept = boosting._shared(rows, first)
    lists = np.split(kept, ends[:-1])
    assert [lists[n].tolist() for n in number] == [[0, 2, 5], [1], [0, 2, 5], [1], [3], [3]] and len(lists) == 3
    assert [len(x) for x in boosting._shared(np.zeros(0, np.uint16), np.zeros(0, np.int64))] == [0, 0, 0]


@pytest.mark.parametrize("slots", [1, 3])
def test_sums_of_a_block_are_those_of_its_entries(slots):
    rng = np.random.default_rng(4)
    filled = rng.random((9, 30)) < 0.3  # by cell and row, some cells alike
    filled[5], filled[7] = filled[2], filled[2]
    filled[:, 0] = True
    rows, first = np.nonzero(filled)[1].astype(np.uint16), np.append(0, np.cumsum(filled.sum(axis=1)))[:-1]
    block = (np.arange(9, dtype=np.int32) * 2, *boosting._shared(rows, first))
    what = rng.random(30) + 1j * rng.random(30)
    for slot in (rng.integers(-1, slots, 30).astype(np.int16), np.zeros(30, np.int16), np.full(30, -1, np.int16)):
        found, expected = np.zeros((18, slots), np.complex128), np.zeros((18, slots), np.complex128)
        boosting._add_up(found, *block, slot, what)
        for cell, row in zip(*np.nonzero(filled)):
            if slot[row] >= 0:
                expected[2 * cell, slot[row]] += what[row]
        assert np.allclose(found, expected, atol=1e-12)


def test_a_level_adds_up_the_rows_of_the_lighter_children_only(spark, monkeypatch):
    asked, best = [], boosting._best
    monkeypatch.setattr(boosting, "_best", lambda *a: asked.append((a[5], a[6])) or best(*a))
    boosting.fit(sparse_rows(spark, 600, 12, 7).localCheckpoint(), 12, 1, 0.3, 4, 42)
    assert asked[0] == ([0], {}) and len(asked) > 2
    for built, siblings in asked[1:]:
        assert len(built) == len(siblings) and sorted(n for n, _ in siblings.values()) == sorted(built)


def test_a_large_batch_is_cut_into_blocks_and_a_setting_is_put_back(spark, monkeypatch):
    rows, name = sparse_rows(spark, 600, 12, 7).localCheckpoint(), "spark.sql.execution.arrow.maxBytesPerBatch"
    before, one = spark.conf.get(name, None), boosting.fit(rows, 12, 2, 0.3, 3, 42)
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", 20)
    many = boosting.fit(rows, 12, 2, 0.3, 3, 42)
    assert probabilities(one, rows) == pytest.approx(probabilities(many, rows), abs=1e-12) and spark.conf.get(name, None) == before
