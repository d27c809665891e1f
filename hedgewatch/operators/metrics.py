"""Metrics of an analysis run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch.operators.selection import kth_smallest

QUANTILE = 0.95
# Rank error of the approximate value is n / ACCURACY.
ACCURACY = 100_000


def alert_totals(alerts: DataFrame) -> DataFrame:
    """One row of counts and token sums over alerts."""
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
    ).withColumns({
        "total_llm_calls": F.col("total_alerts") - F.col("cache_hits"),
        "cache_hit_rate": F.when(F.col("total_alerts") > 0, F.round(
            F.col("cache_hits") / F.col("total_alerts"), 3)).otherwise(F.lit(0.0)),
    })


def hit_types(alerts: DataFrame) -> DataFrame:
    """Hits per hit type, long form."""
    return alerts.filter("cache_hit").groupBy(
        F.coalesce("cache_hit_type", F.lit("unknown")).alias("hit_type")).agg(F.count("*").alias("hits"))


def latency_totals(lines: DataFrame) -> DataFrame:
    """Line count, total time, throughput and mean over all lines' ``latency_ms``."""
    total_s = F.col("__sum") / 1000.0
    return lines.agg(
        F.count("*").alias("total_lines"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("__sum"),
    ).withColumns({
        "total_time_s": F.round(total_s, 2),
        "throughput_ev_s": F.when(total_s > 0, F.round(F.col("total_lines") / total_s, 1)).otherwise(F.lit(0.0)),
        "latency_avg_ms": F.when(F.col("total_lines") > 0, F.round(
            F.col("__sum") / F.col("total_lines"), 2)).otherwise(F.lit(0.0)),
    }).drop("__sum")


def latency_p95(lines: DataFrame, exact: bool = True) -> DataFrame:
    """``latency_p95_ms``: element ``floor(0.95 n)``, from 0, of the sorted
    latencies (not the same as a discrete percentile when 0.95 n is whole).

    Exact without a global sort: a sketch brackets the element, then only the
    distinct values inside the bracket are counted and ranked.
    """
    values = lines.select(F.col("latency_ms").alias("v"))
    if not exact:
        return values.agg(F.round(F.percentile_approx("v", F.lit(QUANTILE), F.lit(ACCURACY)), 2)
                          .alias("latency_p95_ms"))
    rows = values.withColumn("one", F.lit(1))
    wanted = rows.groupBy("one").agg((F.floor(F.count("*") * QUANTILE) + 1).alias("k"))
    found = kth_smallest(rows, wanted, "one", "v")
    return found.agg(F.coalesce(F.round(F.min("v"), 2), F.lit(0.0)).alias("latency_p95_ms"))


def progress(lines: DataFrame, total_lines: int | None = None) -> DataFrame:
    """Progress marks ``(processed, total)``: every hundredth of the input, at least
    every line, and the last line."""
    if total_lines is None:
        total = lines.agg(F.max("line_number").alias("t")).scalar()
    else:
        total = F.lit(total_lines).cast("bigint")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(total / 100))
    number = F.col("line_number")
    return lines.filter((number % step == 0) | (number == total)).select(
        number.alias("processed"), total.alias("total"))


def session_metrics(lines: DataFrame | None, alerts: DataFrame, total_lines: int | None = None) -> DataFrame:
    """One row with everything above. ``lines`` has ``latency_ms`` per line. Where
    there is none, give the number of lines instead; times are then NULL."""
    if lines is not None:
        run = latency_totals(lines).withColumn("latency_p95_ms", latency_p95(lines).scalar())
    else:
        one = alerts.sparkSession.range(1)
        run = one.select(F.lit(total_lines).cast("bigint").alias("total_lines")).withColumns({
            c: F.lit(None).cast("double")
            for c in ("total_time_s", "throughput_ev_s", "latency_avg_ms", "latency_p95_ms")})
    totals = alert_totals(alerts)
    types = hit_types(alerts).agg(F.map_from_entries(F.collect_list(F.struct("hit_type", "hits"))))
    return run.withColumn("t", totals.select(F.struct("*")).scalar()).select(
        *run.columns, "t.*").withColumn("cache_hit_types", types.scalar())
