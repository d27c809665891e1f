"""Whole runs and streams: registered queries. Each writes its input, derived from
the tables, to the session's checkpoint folder and reads its own output back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.checks import inputs
from hedgewatch.checks.registry import register
from hedgewatch.checks.sql import statement, type_name
from hedgewatch.functions.policy import attack_type_name
from hedgewatch.functions.verdict import VERDICT
from hedgewatch.operators.reuse import CLASS, admit_exact
from hedgewatch.plans.session import Options, run_session
from hedgewatch.session import checkpoint_dir, cut_lineage
from hedgewatch.sources import verdict_store
from hedgewatch.streaming import incremental

# a run without a provider stores ``unknown`` for whatever it has to ask, so an
# event reuses it if it has no context of its own and its key came up before
_RUN = statement(
    """SELECT line_number, context_type = 'unknown' AND rn > 1 AS cache_hit FROM (
      SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY line_number) AS rn FROM contexts)""", "contexts")


#: Lines of a file of a log folder.
FILE_LINES = 250_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def _log_folder(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "logs")
    # events are dealt, not lines: they are narrower, and each line is made once, not for the ranges as well
    events = inputs.table(spark, sf_dir, "events")
    parts = max(spark.sparkContext.defaultParallelism, -(-events.count() // FILE_LINES))
    # sorted after the join with the templates: the optimizer drops an order below it
    lines = inputs.lines_of_events(events.repartitionByRange(parts, "event_id")).sortWithinPartitions("line_number")
    # no _SUCCESS marker: in this folder every file is a log
    lines.select("value").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)
    return path


def _scorer(log: DataFrame) -> DataFrame:
    return log.withColumn("ml_score", (((F.col("line_number") - 1) * 37) % 101) / 100.0)


@register("session_run", _RUN)
def session_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory analysed from text files to alerts."""
    out = _folder(spark, "run")
    session_id = run_session(spark, _log_folder(spark, sf_dir), out, Options(scorer=_scorer))
    alerts = spark.read.parquet(f"{out}/alerts")
    return alerts.filter(F.col("session_id") == session_id).select("line_number", "cache_hit")


@register("session_run_without_reuse", statement("SELECT line_number, FALSE AS cache_hit FROM flagged", "flagged"))
def session_run_without_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "run")
    run_session(spark, _log_folder(spark, sf_dir), out, Options(scorer=_scorer, use_reuse=False))
    return spark.read.parquet(f"{out}/alerts").select("line_number", "cache_hit")


@register("incremental_run", _RUN)
def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the directory, all files in one batch."""
    out = _folder(spark, "incremental")
    query = incremental.run_incremental(
        spark, _log_folder(spark, sf_dir), out, _folder(spark, "stream"), Options(scorer=_scorer))
    query.awaitTermination()
    return spark.read.parquet(f"{out}/alerts").select("line_number", "cache_hit")


_SEVERITIES = ("low", "medium", "high", "critical")
# half of all events have one key; the verdict asked for carries the line that asked
_HOT = "CASE WHEN line_number % 2 = 0 THEN 'hot' ELSE canonical_key END"


@register("streamed_exact_reuse", statement(
    f"""SELECT line_number, CASE WHEN hit THEN 'exact' ELSE 'miss' END AS outcome, CASE WHEN hit THEN context_type END AS reused_type,
      'asked at ' || asked AS explanation, ({list(_SEVERITIES)})[asked % 4 + 1] AS severity, asked % 700 AS input_tokens
    FROM (SELECT *, last_value(CASE WHEN NOT hit THEN first_line END IGNORE NULLS) OVER (PARTITION BY key ORDER BY line_number) AS asked
      FROM (SELECT *, coalesce(lag(context_type) OVER (PARTITION BY key ORDER BY line_number) = context_type, FALSE) AS hit,
          min(line_number) OVER (PARTITION BY key, context_type, context_family, part) AS first_line
        FROM (SELECT *, {_HOT} AS key, line_number * 3 // ((SELECT max(line_number) FROM contexts) + 1) AS part FROM contexts)))""", "contexts"))
def streamed_exact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole verdicts kept in a store while events arrive in three micro-batches; every verdict confirms its context."""
    source, out, store, checkpoint = (_folder(spark, n) for n in ("contexts", "outcomes", "store", "stream"))
    line = F.col("line_number")
    given = {"attack_type": F.col("context_type"), "explanation": F.concat(F.lit("asked at "), line.cast("string")),
             "severity": F.get(F.array(*map(F.lit, _SEVERITIES)), (line % 4).cast("int")), "input_tokens": line % 700}
    verdict = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VERDICT.fields])
    rows = cut_lineage(inputs.contexts(spark, sf_dir).select(*CLASS, "line_number").withColumns({
        "canonical_key": F.expr(_HOT), "verdict": verdict}))
    last = rows.agg(F.max("line_number").alias("last")).scalar()
    for part in range(3):
        rows.where(F.floor(line * 3 / (last + 1)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        incremental.stream_reuse(stream, store, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("line_number", "outcome", "reused_type", "verdict.explanation", "verdict.severity", "verdict.input_tokens")


@register("streamed_upsert", statement(
    """SELECT 'line:' || (line_number % 1000) AS alert_key, arg_max(severity, line_number) AS severity, max(line_number) AS arrival
    FROM alerts GROUP BY 1""", "alerts"))
def streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts arriving in line order, in three micro-batches, under a thousand recurring line numbers."""
    source, out, checkpoint = (_folder(spark, n) for n in ("arrivals", "latest", "stream"))
    rows = cut_lineage(inputs.alerts(spark, sf_dir).select(
        (F.col("line_number") % 1000).alias("line_number"), "timestamp", "source_ip", "path", "merged_score",
        "severity", F.col("line_number").alias("arrival")))
    last = rows.agg(F.max("arrival").alias("last")).scalar()
    for part in range(3):
        rows.where(F.floor(F.col("arrival") * 3 / (last + 1)) == part).write.mode("append").parquet(source)
        incremental.stream_upsert(spark.readStream.schema(rows.schema).parquet(source), out, checkpoint).awaitTermination()
    return incremental.latest_upsert(spark, out).select("alert_key", "severity", "arrival")


@register("verdict_store_lookup", statement(
    f"""SELECT canonical_key, arg_max(kind, line_number) AS cached_type, max(line_number) AS line_number
    FROM (SELECT k.canonical_key, k.line_number, {type_name('v_attack_type')} AS kind
          FROM contexts k JOIN judged j USING (line_number)) GROUP BY canonical_key
    HAVING bool_or(line_number % 10 = 3)""", "contexts", "judged"))
def verdict_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six batches in a log-structured store, merged on the way; looked up by the keys of a tenth of the events."""
    path = _folder(spark, "store")
    keyed = cut_lineage(inputs.with_verdicts(inputs.contexts(spark, sf_dir)).select("canonical_key", "line_number", "verdict"))
    empty = spark.createDataFrame([], verdict_store.ENTRIES)
    last = keyed.agg(F.max("line_number").alias("last")).scalar()
    for batch in range(6):
        own = keyed.where(F.floor(F.col("line_number") * 6 / (last + 1)) == batch)
        verdict_store.write_store(path, admit_exact(own), empty, batch + 1)
    exact, _ = verdict_store.read_store(spark, path, keys=keyed.where("line_number % 10 = 3"))
    return exact.select("canonical_key", attack_type_name(F.col("verdict.attack_type")).alias("cached_type"), "line_number")
