"""Pages of any depth: alerts stored in display order by ranges with known counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.operators.search import sort_columns
from hedgewatch.sources.files import remove

#: Rows of a range: what a page's task reads.
RANGE_ROWS = 50_000
#: Rows of a part, at least: what a task sorts and writes, however small the ranges in it are.
PART_ROWS = 50_000


def build_rank_index(alerts: DataFrame, path: str, sort_by: str = "line_number", sort_order: str = "desc",
                     range_rows: int = RANGE_ROWS) -> None:
    """Write ``alerts`` to ``path`` in the order of ``page_of``, in ranges of at most ``range_rows``.

    Alerts are found once and written, then dealt to parts by a sample of the sort columns, a folder each; a row knows its place in
    its part, every ``range_rows`` of them are a range, and the ranges' counts tell where each begins. Nothing is sorted as a whole,
    and tasks and files grow with the rows, not with the ranges: a range is found in its file by the places of the file's pages.
    """
    spark, order = alerts.sparkSession, sort_columns(sort_by, sort_order)
    alerts.write.mode("overwrite").parquet(f"{path}/unordered")
    found = spark.read.schema(alerts.schema).parquet(f"{path}/unordered")
    parts = max(1, -(-found.count() // max(range_rows, PART_ROWS)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place})
    ranged = dealt.withColumn("__range", F.expr(f"__place DIV {range_rows}"))
    ranged.write.option("parquet.page.row.count.limit", range_rows).partitionBy("__part").mode("overwrite").parquet(f"{path}/rows")
    ranged.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    counts = spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy("__part", "__range").agg(
        F.count(F.lit(1)).alias("n"), F.min("__place").alias("start"))
    before = F.sum("n").over(Window.orderBy("__part", "__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    counts.withColumn("first", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    remove(spark, f"{path}/unordered")


def _met(spark: SparkSession, path: str, page: int, page_size: int) -> list[Row]:
    start = (page - 1) * page_size
    met = spark.read.parquet(f"{path}/ranges").where((F.col("first") < start + page_size) & (F.col("first") + F.col("n") > start))
    return met.orderBy("first").collect()  # at most as many as a page has rows


def ranges_of_page(spark: SparkSession, path: str, page: int, page_size: int) -> dict[tuple[int, int], int]:
    """The ranges (part, range in it) that a page lies in, and how many rows come before each."""
    return {(r["__part"], r["__range"]): r["first"] for r in _met(spark, path, page, page_size)}


def page_from_index(spark: SparkSession, path: str, page: int = 1, page_size: int = config.PAGE_SIZE_DEFAULT) -> DataFrame:
    """One page as ``page_of`` gives it; opens the ranges that it lies in, one or two, however deep it is."""
    page, page_size = max(1, page), max(1, min(page_size, config.PAGE_SIZE_MAX))
    start, own = (page - 1) * page_size, ("__part", "__range", "__place")
    met = {r["__part"]: r["first"] - r["start"] for r in _met(spark, path, page, page_size)}  # rows before each part
    stored = spark.read.schema(spark.read.parquet(f"{path}/schema").schema)
    if not met:
        return stored.parquet(f"{path}/schema").withColumn("rank", F.lit(0).cast("bigint")).drop(*own)
    pages = []
    for part, before in met.items():
        rows = stored.option("basePath", f"{path}/rows").parquet(f"{path}/rows/__part={part}")
        pages.append(rows.where(F.col("__place").between(start - before, start - before + page_size - 1)).withColumn(
            "rank", F.col("__place") + F.lit(before + 1).cast("bigint")))
    return reduce(DataFrame.unionByName, pages).drop(*own)
