"""One analysis run over a log directory."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.operators.detect import apply_rules
from hedgewatch.operators.ingest import parse, source_of_line
from hedgewatch.operators.metrics import session_metrics
from hedgewatch.operators.reuse import Embedder, with_context
from hedgewatch.operators.score import merge_and_flag
from hedgewatch.operators.train import score
from hedgewatch.operators.verdicts import Provider
from hedgewatch.plans.batch import BatchResult, with_reuse, without_reuse
from hedgewatch.sources.logs import first_line, scan_logs
from hedgewatch.sources.rules import load_rules
from hedgewatch.sources.verdict_store import next_batch, read_store, write_store


@dataclass
class Options:
    """``scorer`` adds ``ml_score`` to the access log; or give a trained ``model``.
    Without a ``provider`` flagged events that find no stored verdict get the
    fallback verdict. ``journal`` is a shared folder of answers, kept between runs."""
    source: str = "auto"
    use_reuse: bool = True
    rules_json: str | None = None
    model: PipelineModel | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None
    provider: Provider | None = None
    embedder: Embedder | None = None
    store_path: str | None = None
    journal: str | None = None
    threshold: float = config.ALERT_THRESHOLD
    max_store_entries: int = config.STORE_MAX_ENTRIES


def detect(spark: SparkSession, raw_lines: DataFrame, source: str, options: Options) -> DataFrame:
    """Lines to flagged events: parse, rules, score, merge, filter, key. No shuffle."""
    if options.scorer is None and options.model is None:
        raise ValueError("give a scorer or a model")
    log = apply_rules(parse(raw_lines, source), load_rules(spark, options.rules_json))
    scored = options.scorer(log) if options.scorer else score(log, options.model)
    flagged = merge_and_flag(scored, options.threshold)
    # keys are written with the events: several later steps read them
    return with_context(flagged) if options.use_reuse else flagged


def resolve(spark: SparkSession, flagged: DataFrame, options: Options,
            batch: int | None = None) -> tuple[BatchResult, int]:
    if not options.use_reuse:
        return without_reuse(flagged, options.provider, options.journal), 0
    store = options.store_path
    batch = batch if batch is not None else (next_batch(spark, store) if store else 1)
    # only files that may hold one of the batch's keys are opened
    exact, entries = read_store(spark, store, before_batch=batch, keys=flagged.select("canonical_key")) if store else read_store(
        spark, f"/nonexistent-{uuid.uuid4()}")
    return with_reuse(flagged, exact, entries, options.provider, options.embedder,
                      options.max_store_entries, journal=options.journal), batch


def session_source(spark: SparkSession, path: str, source: str) -> str:
    """The format of a directory: that of its very first line."""
    if source != "auto":
        return source
    return source_of_line(spark, first_line(spark, path))


def run_session(spark: SparkSession, path: str, out: str, options: Options,
                session_id: str | None = None) -> str:
    """Analyse a directory and write ``flagged``, ``alerts``, ``metrics`` and
    ``sessions`` below ``out``, each under ``session_id=<id>``. Returns the id; a
    new run over the same directory is a new session.

    One lazy plan up to the flagged events, which are written; a second one from
    those to the alerts; a third one for the metrics.
    """
    session_id = session_id or str(uuid.uuid4())

    def folder(table: str) -> str:
        return f"{out}/{table}/session_id={session_id}"

    started = time.time()
    scan = scan_logs(spark, path)
    source = session_source(spark, path, options.source)
    total = scan.total()
    # one array for the session's row; the names never pass through the driver or the plan
    files = scan.splits.agg(F.sort_array(F.collect_set("file_name")).alias("input_files"))
    detect(spark, scan.lines, source, options).write.mode("overwrite").parquet(folder("flagged"))
    flagged = spark.read.parquet(folder("flagged"))

    result, batch = resolve(spark, flagged, options)
    result.alerts.write.mode("overwrite").parquet(folder("alerts"))
    alerts = spark.read.parquet(folder("alerts"))
    if result.new_exact is not None and options.store_path:
        write_store(options.store_path, result.new_exact, result.entries, batch)

    metrics = session_metrics(None, alerts, total).withColumns({
        "use_cache": F.lit(options.use_reuse), "source": F.lit(source), "input_dir": F.lit(path),
        "input_files": files.scalar(),
        "elapsed_s": F.lit(time.time() - started)})
    metrics.coalesce(1).write.mode("overwrite").parquet(folder("metrics"))
    session = spark.createDataFrame(
        [("done" if total else "idle", total, total, options.use_reuse, path, source, started)],
        "status string, progress bigint, total_lines bigint, use_cache boolean, "
        "input_dir string, source string, created_at double").withColumn("input_files", files.scalar()).withColumn(
        "filename", F.nullif(F.array_join("input_files", ", "), F.lit("")))
    session.coalesce(1).write.mode("overwrite").parquet(folder("sessions"))
    return session_id
