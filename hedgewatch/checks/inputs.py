"""Inputs of the registered queries as DataFrames over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.checks.templates import AGENTS, ANSWERS, TEMPLATES
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.text import quoted
from hedgewatch.functions.verdict import parsed_verdict, strip_fences
from hedgewatch.operators.alerts import build_alerts
from hedgewatch.operators.detect import apply_rules
from hedgewatch.operators.ingest import parse
from hedgewatch.operators.reuse import with_context
from hedgewatch.operators.score import merge_and_flag


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task over a dealt table: of events (a line to parse each) and of documents (a text each).
EVENT_ROWS, DOCUMENT_ROWS = 25_000, 5_000


def spread(df: DataFrame, task_rows: int) -> DataFrame:
    """Deal the rows of a scan to tasks where its splits do not: every core is used, and a task holds about
    ``task_rows`` rows, however many the table has.

    Splits are ranges of bytes, but a row group is read whole by one of them, so a split may hold nothing or a
    million rows; rows per split are counted (from the footers, no column is read). A scan whose splits are
    many enough and small enough is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count("*").alias("n"))
    filled, most, rows = splits.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if filled >= cores and most <= 2 * task_rows:
        return df
    return df.repartition(max(cores, -(-rows // task_rows)))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event, with the event's columns alongside."""
    return lines_of_events(spread(table(spark, sf_dir, "events"), EVENT_ROWS))


def lines_of_events(events: DataFrame) -> DataFrame:
    """``raw_lines`` of given events; no shuffle."""
    spark = events.sparkSession
    templates = spark.createDataFrame(list(enumerate(TEMPLATES)), "t int, line string")
    joined = events.withColumn("t", F.expr(f"CAST(event_id % {len(TEMPLATES)} AS INT)")).join(
        F.broadcast(templates), "t")
    agents = ", ".join(quoted(a) for a in AGENTS)
    line = "line"
    for name, value in {
        "IP": "concat_ws('.', '10', CAST(user_id % 250 AS STRING), CAST(event_id % 200 AS STRING), CAST(user_id % 99 AS STRING))",
        "TS": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
        "SZ": "CAST(CAST(floor(value * 100) AS BIGINT) AS STRING)",
        "AGENT": f"get(array({agents}), CAST(user_id % {len(AGENTS)} AS INT))",
        "U": "CAST(user_id AS STRING)", "E": "CAST(event_id AS STRING)",
    }.items():
        line = f"replace({line}, '@{name}@', {value})"
    return joined.selectExpr("event_id + 1 AS line_number", f"{line} AS value",
                             "event_id", "user_id", "event_type", "ts")


def access_log(spark: SparkSession, sf_dir: str, source: str = "auto") -> DataFrame:
    return parse(raw_lines(spark, sf_dir), source)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(access_log(spark, sf_dir))


def with_given_score(df: DataFrame) -> DataFrame:
    """A content score from the event itself: a trained model has no SQL form."""
    return df.withColumn("ml_score", ((F.col("event_id") * 37) % 101) / 100.0)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_and_flag(with_given_score(detected(spark, sf_dir)))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(flagged(spark, sf_dir))


def answers(df: DataFrame) -> DataFrame:
    """``raw``: a provider's answer per line."""
    listed = F.array(*[F.lit(a) for a in ANSWERS])
    return df.withColumn("raw", F.get(listed, (F.col("line_number") % len(ANSWERS)).cast("int")))


def with_verdicts(df: DataFrame) -> DataFrame:
    staged = answers(df).withColumns({
        "answer": strip_fences(F.col("raw")),
        "input_tokens": F.col("line_number") % 700, "output_tokens": F.col("line_number") % 90})
    usage = {c: F.col(c) for c in ("input_tokens", "output_tokens")}
    return with_columns_once(staged, {"verdict": parsed_verdict(F.col("answer"), usage)}).drop(
        "answer", "raw", "input_tokens", "output_tokens")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all flagged events; views and clicks count as reused verdicts."""
    kind = F.col("event_type")
    hit = kind.isin("view", "click")
    return build_alerts(with_verdicts(flagged(spark, sf_dir)).withColumns({
        "session_id": F.concat(F.lit("s"), F.col("user_id").cast("string")),
        "latency_ms": latency(),
        "cache_hit": hit,
        "cache_hit_type": F.when(kind == "view", "exact").when(kind == "click", "semantic"),
        "cache_similarity": F.when(kind == "view", F.lit(1.0)).otherwise(F.lit(0.912345)),
        "cached_attack_type": F.col("primary_type"),
        "cache_decision_reason": F.lit("exact_canonical_key"),
        "cache_policy_mode": F.lit("attack_type_aware"),
    }))


def latency() -> Column:
    return (F.col("event_id") * 7919 % 10007) / 100.0


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_acctbal") < 0, "idle").when(F.col("s_nationkey") < 5, "processing").otherwise("done")
    return supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("session_id"),
        status.alias("status"), F.col("s_suppkey").alias("progress"),
        (F.col("s_suppkey") * 2).alias("total_lines"),
        (F.col("s_acctbal") + F.col("s_suppkey") / 1000.0).alias("created_at"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), DOCUMENT_ROWS).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("toxic").alias("label"), "quality", "n_chars")
