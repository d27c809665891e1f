"""Hard negatives against all scores; the column scan against products."""

import math

import numpy as np
import pytest

from hedgewatch.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label long, rank int, score int"
MOST = (1 << 63) - 1


def slow(rows, every=50, positives=5, least=50, most=95, k=3):
    usable = [(i, [math.floor(256 * v) for v in x], y) for i, x, y in rows
              if None not in (i, y) and x and all(v is not None and math.isfinite(v) for v in x)]
    score = lambda a, b: max(-MOST, min(MOST, sum(p * q for p, q in zip(a, b, strict=False))))
    out = []
    for a, x, y in usable:
        if a % every == 0:
            own = sorted((-score(x, v), i) for i, v, z in usable if z == y and i != a)[:positives]
            other = sorted((-score(x, v), i) for i, v, z in usable if z != y)
            for s, p in own:
                found = [(n, i) for n, i in other if least * -s <= 100 * -n <= most * -s][:k]
                out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, x, y, 0, 0) for i, x, y in rows], VECTORS)
    return sorted(map(tuple, negatives.mine(negatives.usable_rows(df), **sizes).collect()))


def clouds(seed, groups, width, spread=0.2, labels=4):
    """Clusters whose members have labels of their cluster and others; many equal vectors, hence ties."""
    draw = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(groups):
        centre = draw.standard_normal(width)
        for _ in range(n):
            vector = np.round(centre + spread * draw.standard_normal(width), 1 if g % 2 else 6)
            rows.append(([float(v) for v in vector], int(draw.integers(labels)) if draw.random() < 0.3 else g % labels))
    return [(i, x, y) for i, (x, y) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "groups", "width"), [(1, (400, 60, 60, 30, 2, 1), 16), (2, (50,) * 8, 3), (3, (150, 150), 1)])
def test_against_all_scores(spark, seed, groups, width):
    rows = clouds(seed, groups, width)
    expected = slow(rows)
    assert expected and mined(spark, rows, block_rows=64, group_anchors=4) == expected


def test_pages_and_one_block(spark, monkeypatch):
    """One label holds most rows; boxes come in several pages, then all in one block."""
    rows = [(i, x, 7 if i % 9 else y) for i, x, y in clouds(4, (300, 100), 8)]
    expected = slow(rows)
    assert mined(spark, rows) == expected
    monkeypatch.setattr(negatives, "PAGE_BOXES", 3)
    assert mined(spark, rows, block_rows=32, group_anchors=3) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (50, [1.0], 1), (100, [2.0, 1.0], 2), (1, None, 1), (2, [], 1), (3, [nan, 1.0], 2), (4, [inf], 2), (5, [None, 1.0], 2),
            (None, [1.0, 1.0], 2), (6, [1.0, 1.0], None), (7, [1.0, 1.5], 2), (7, [1.0, 1.5], 2), (8, [0.9, 1.5], 1), (9, [0.9, 1.5], 3), (10, [0.0, 0.0], 3),
            (100, [2.0, 1.0], 2), (11, [-1.0, -1.0], 1), (150, [5.0, 5.0], 9), (200, [0.0, 0.0], 2)]
    assert mined(spark, rows) == slow(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(50, None, 1)]) == []


def test_scores_beyond_doubles_and_longs(spark):
    draw = np.random.default_rng(9)
    rows = [(i, [float(v) for v in draw.standard_normal(4) * 1e6], i % 3) for i in range(0, 120)] + [
        (200 + i, [float(v) for v in draw.standard_normal(4) * 1e5 + 3e6], i % 3) for i in range(60)]
    assert mined(spark, rows, block_rows=16) == slow(rows)
    huge = [(0, [1e308, 1.0], 0), (50, [1e200, -1e200], 0), (1, [1e308, 1e308], 0), (2, [-1e300, 2.0], 1), (3, [1.0, 1.0], 1)]
    mined(spark, huge)  # whatever their order: no failure


def test_scan_reads_columns_until_exact():
    draw = np.random.default_rng(3)
    columns = np.floor(draw.standard_normal((32, 500)) * 256)
    row = {"ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "columns": columns.tobytes(),
           "low": columns.min(axis=1).tobytes(), "high": columns.max(axis=1).tobytes()}
    block = negatives.Block(row, 32)
    for _ in range(50):
        anchor = np.floor(draw.standard_normal(32) ** 3 * 100)
        scores = (anchor @ columns).astype(np.int64)
        low, high = np.sort(scores)[[440, 480]]
        candidates = np.flatnonzero(draw.random(500) < 0.7)
        places, found = negatives.scan(block, anchor, candidates, float(low), float(high))
        assert set(candidates[(scores[candidates] >= low) & (scores[candidates] <= high)]) <= set(places) and (scores[places] == found).all()


def test_boxes_bound_all_products():
    draw = np.random.default_rng(4)
    rows, points = draw.standard_normal((100, 8)), draw.standard_normal((20, 8))
    under, over = negatives.box_bounds(points, rows.min(axis=0)[None], rows.max(axis=0)[None])
    assert (under[:, 0] <= (points @ rows.T).min(axis=1)).all() and (over[:, 0] >= (points @ rows.T).max(axis=1)).all()
