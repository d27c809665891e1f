"""Whitening against whole-matrix arithmetic."""

import math

import numpy as np
import pytest

from hedgewatch.llm import queries, whitening


def integers(rows):
    return np.floor(64 * np.asarray(rows, float)).astype(np.int64) + 1_000_000


def expected_deviation(x):
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    return [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]


def compare(found, ids, rows, components=32):
    x = integers(rows)
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / len(x)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {r["vec_id"]: r for r in found}
    assert sorted(got) == sorted(ids)
    k = len(next(iter(got.values()))["whitened"])
    assert k == min(components, np.linalg.matrix_rank(covariance))
    for i, d in zip(ids, expected_deviation(x), strict=True):
        assert got[i]["deviation"] == d and got[i]["n"] == len(x) and got[i]["identity_error"] < 1e-9
    explained = np.array(got[ids[0]]["explained"])
    assert np.allclose(explained, values[:k] / np.trace(covariance), rtol=1e-9)
    whitened = np.array([got[i]["whitened"] for i in ids])
    assert np.abs(whitened.T @ whitened / len(x) - np.eye(k)).max() < 1e-9
    # Components apart from each other are those of the whole matrix, up to sign; so is the span of all.
    for c in range(k):
        if np.abs(values[c] - np.delete(values, c)).min(initial=np.inf) > 1e-3 * values[0]:
            other = centred @ vectors[:, c] / math.sqrt(values[c])
            assert min(np.abs(whitened[:, c] - other).max(), np.abs(whitened[:, c] + other).max()) < 1e-7


def frame(spark, ids, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>")


def test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()
    compare(found, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    long = queries.op12_householder_whitening(spark, sf_dir)
    assert long.count() == 32 * len(rows) and {r[0] for r in long.select("component").distinct().collect()} == set(range(1, 33))


@pytest.mark.parametrize(("width", "count", "rank"), [(1, 5, 1), (2, 9, 2), (3, 40, 3), (40, 200, 40), (12, 60, 5)])
def test_widths_and_ranks(spark, width, count, rank):
    draw = np.random.default_rng(width)
    rows = np.round(draw.standard_normal((count, rank)) * 8) @ np.round(draw.standard_normal((rank, width)) * 4) if rank < width else draw.standard_normal((count, width))
    compare(whitening.whiten(frame(spark, range(count), rows)).collect(), list(range(count)), rows.astype(np.float32))


def test_equal_eigenvalues(spark):
    """A cluster of equal eigenvalues: any orthogonal basis will do."""
    rows = np.concatenate([np.eye(10), -np.eye(10)]) * 4
    found = whitening.whiten(frame(spark, range(20), rows)).collect()
    whitened = np.array([r["whitened"] for r in found])
    assert whitened.shape == (20, 10) and np.abs(whitened.T @ whitened / 20 - np.eye(10)).max() < 1e-10


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 2.0], [1.0], [], [3.0, -1.0], [3.0, -1.0]]
    df = spark.createDataFrame([(None if i == 8 else i, v, 0, 0) for i, v in enumerate(odd)],
                               "vec_id long, embedding array<double>, n int, deviation int")
    found = whitening.whiten(df).collect()
    x = integers([[1, 2], [1, 0], [0, 0], [3, -1], [3, -1]])
    assert sorted((r["deviation"], r["vec_id"] or -1) for r in found) == sorted(zip(expected_deviation(x), [4, 5, 6, 7, -1], strict=True))
    assert {r["n"] for r in found} == {5} and all(len(r["whitened"]) == 2 for r in found)
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.where("vec_id = 4")).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["n"]) for r in one] == [(0, [], [], 1)]


def test_large_entries_stay_exact(spark):
    rows = [[1e9, 0.0], [1e9, 1.0], [-3e11, 2.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r] for r in rows], object)
    assert [r["deviation"] for r in sorted(whitening.whiten(df).collect())] == [min(d, (1 << 63) - 1) for d in expected_deviation(x)]
    huge = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(huge).where("vec_id < 2").collect()} == {(1 << 63) - 1}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_eigenvalues_by_bisection(n):
    draw = np.random.default_rng(n)
    a = draw.standard_normal((n, n))
    a = a @ a.T
    values, vectors = whitening.leading_components(a, n)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-12 * np.trace(a))
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * np.trace(a) and np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-10
