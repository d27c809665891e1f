"""Order statistics and pages of stored alerts against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from hedgewatch.operators import rank_index, search, selection


@pytest.mark.parametrize("rest", [1, 7, 10_000])
def test_kth_smallest(spark, monkeypatch, rest):
    monkeypatch.setattr(selection, "REST", rest)
    monkeypatch.setattr(selection, "BUCKETS", 8)
    draw = random.Random(rest)
    groups = {"flat": [1.5] * 300, "wide": [draw.lognormvariate(0, 8) * draw.choice([-1, 1]) for _ in range(700)],
              "far": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "ties": [float(draw.randrange(4)) for _ in range(500)], "one": [3.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("flat", None), (None, 1.0)], "g string, v double").repartition(5)
    for share in (0.001, 0.3, 0.95, 1.0):
        ranks = {g: max(1, int(len(vs) * share)) for g, vs in groups.items()}
        found = selection.kth_smallest(rows, spark.createDataFrame([*ranks.items(), ("none", 1)], "g string, k long"), "g", "v")
        assert dict(map(tuple, found.collect())) == {g: sorted(vs)[ranks[g] - 1] for g, vs in groups.items()}
    outside = spark.createDataFrame([("one", 2), ("ties", 0)], "g string, k long")
    assert selection.kth_smallest(rows, outside, "g", "v").count() == 0


def test_a_million_distinct_longs(spark):
    rows = spark.range(1_000_000).selectExpr("1 AS g", "(id * 7919) % 1000003 AS v")
    found = selection.kth_smallest(rows, spark.createDataFrame([(1, 950_001)], "g int, k long"), "g", "v")
    assert found.first()["v"] == sorted(i * 7919 % 1000003 for i in range(1_000_000))[950_000]


def test_no_window_without_key(spark):
    """Only the counts of a round are ranked, and per group."""
    rows = spark.range(50_000).selectExpr("1 AS g", "id AS v")
    plan = selection.kth_smallest(rows, spark.createDataFrame([(1, 5)], "g int, k long"), "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize(("by", "order"), [("merged_score", "desc"), ("timestamp", "asc"), ("line_number", "desc")])
def test_pages_of_any_depth(spark, tmp_path, by, order):
    path = str(tmp_path / "ranked")
    alerts = spark.range(1003).selectExpr("id AS line_number", "(id * 37 % 11) / 10.0D AS merged_score", "concat('t', id * 13 % 7) AS timestamp").repartition(4)
    rank_index.build_rank_index(alerts, path, by, order, range_rows=100)
    expected = [r["line_number"] for r in alerts.orderBy(*search.sort_columns(by, order)).collect()]
    for page in (1, 2, 10, 20, 21, 22):
        rows = sorted(rank_index.page_from_index(spark, path, page, 50).collect(), key=lambda r: r["rank"])
        assert [r["line_number"] for r in rows] == expected[(page - 1) * 50:page * 50]
        assert [r["rank"] for r in rows] == list(range((page - 1) * 50 + 1, (page - 1) * 50 + 1 + len(rows)))
        assert len(rank_index.ranges_of_page(spark, path, page, 50)) <= 2
    files = rank_index.page_from_index(spark, path, 21, 50).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) <= 2
    assert spark.read.parquet(f"{path}/ranges").agg(F.sum("n")).first()[0] == 1003


def test_small_ranges_are_no_tasks_and_alerts_are_found_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rank_index, "PART_ROWS", 500)
    path = str(tmp_path / "ranked")
    met = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            met.add(len(batch))
            yield batch

    rows = spark.range(2003).selectExpr("id AS line_number", "(id * 37 % 11) / 10.0D AS merged_score", "concat('t', id * 13 % 7) AS timestamp")
    rank_index.build_rank_index(rows.mapInPandas(watched, rows.schema), path, "merged_score", range_rows=20)
    assert met.value == 2003  # not once more for the count and once for the sample
    assert spark.read.parquet(f"{path}/ranges").where("n <= 20").count() >= 101
    assert len(list((tmp_path / "ranked" / "rows").glob("__part=*"))) <= 5 and not (tmp_path / "ranked" / "unordered").exists()
    expected = [r["line_number"] for r in rows.orderBy(*search.sort_columns("merged_score", "desc")).collect()]
    for page in (1, 20, 40, 41):
        found = sorted(rank_index.page_from_index(spark, path, page, 50).collect(), key=lambda r: r["rank"])
        assert [r["line_number"] for r in found] == expected[(page - 1) * 50:page * 50]


def test_no_alerts_no_pages(spark, tmp_path):
    path = str(tmp_path / "ranked")
    none = spark.range(0).selectExpr("id AS line_number", "0.5D AS merged_score", "'t' AS timestamp")
    rank_index.build_rank_index(none, path)
    assert spark.read.parquet(f"{path}/ranges").count() == 0
    assert rank_index.page_from_index(spark, path).count() == 0 and rank_index.page_from_index(spark, path).columns == [*none.columns, "rank"]
