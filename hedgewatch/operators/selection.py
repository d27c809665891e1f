"""Exact order statistics by narrowing: count values by bucket, go on in the bucket that holds the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch.session import cut_lineage

#: Buckets of a round, and values that are sorted in one row once no more are left.
BUCKETS, REST = 4096, 10_000


def kth_smallest(rows: DataFrame, wanted: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value)``: for each row of ``wanted(group, k)`` the k-th smallest value (from 1) of its group.

    Groups are few (labels, or one). A round is one pass that counts per group at most ``BUCKETS`` buckets of equal width between the
    least and the greatest value still possible, and keeps the bucket that holds the rank with its own least and greatest value; it
    ends when these are equal or at most ``REST`` values are left. No task sorts more than that. NULL values and NULL groups are left
    out; a rank outside 1..n gives no row.
    """
    values = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ranks = wanted.select(F.col(group).alias("g"), F.col("k").cast("bigint").alias("k"))
    ends = values.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    state = cut_lineage(ends.join(ranks, "g").where("k BETWEEN 1 AND n"))
    still_open = "low < high AND n > " + str(REST)
    while not state.where(still_open).isEmpty():
        inside = values.join(F.broadcast(state.where(still_open)), "g").where("v BETWEEN low AND high")
        # halves: the difference of two doubles may be too large for one
        bucket = F.expr(f"least({BUCKETS - 1}L, CAST(floor((v / 2 - low / 2) / (high / 2 - low / 2) * {BUCKETS}) AS BIGINT))")
        counted = inside.groupBy("g", "k", bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        chosen = counted.withColumn("upto", upto).where("upto >= k AND upto - n < k").selectExpr("g", "low", "high", "n", "k - (upto - n) AS k")
        state = cut_lineage(state.where(f"NOT ({still_open})").unionByName(chosen))
    equal = state.where("low = high").select("g", F.col("low").alias("v"))
    rest = values.join(F.broadcast(state.where("low < high")), "g").where("v BETWEEN low AND high").groupBy("g", "k").agg(
        F.sort_array(F.collect_list("v")).alias("all")).select("g", F.expr("element_at(all, CAST(k AS INT))").alias("v"))
    return equal.unionByName(rest).select(F.col("g").alias(group), F.col("v").alias(value))
