"""Incremental runs and streamed reuse on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hedgewatch import config
from hedgewatch.functions.policy import attack_type_name
from hedgewatch.operators.reuse import CLASS, admit_exact, exact_lookup, fold_reuse, join_dealt, number_classes
from hedgewatch.operators.search import alert_key, upsert
from hedgewatch.plans.session import Options, detect, resolve, session_source
from hedgewatch.session import checkpoint_dir, cut_lineage
from hedgewatch.sources.files import listing
from hedgewatch.sources.logs import lines_of, number_lines, refuse_hidden
from hedgewatch.sources.merge_table import merge, read_merged
from hedgewatch.sources.verdict_store import read_store, write_store


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of a directory as a stream; each file is read once. Names that the source
    would leave out raise here, and for files that arrive later when a batch runs."""
    refuse_hidden(spark, path)
    reader = spark.readStream.format("text").option("latestFirst", "false")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select(
        "value", F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"))
    return lines_of(lines, split_unicode_breaks=True)


def run_incremental(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options,
                    max_files: int | None = None) -> StreamingQuery:
    """Process files that arrived since the last run and stop. Each micro-batch is
    resolved against the store as earlier batches left it; files written for a
    batch are replaced if the batch is retried. Line numbers are unique and rise
    with the batch; within one they follow the files in name order.
    """
    source = session_source(spark, path, options.source)

    def batch(lines: DataFrame, batch_id: int) -> None:
        session = lines.sparkSession
        refuse_hidden(session, path)
        scan = number_lines(lines)
        numbered = scan.lines.withColumn(
            "line_number", F.col("line_number") + F.lit(_lines_before(session, out, batch_id)))
        detect(session, numbered, source, options).write.mode("overwrite").parquet(
            f"{out}/flagged/batch={batch_id}")
        flagged = session.read.parquet(f"{out}/flagged/batch={batch_id}")
        result, store_batch = resolve(session, flagged, options, batch=batch_id + 1)
        result.alerts.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")
        if result.new_exact is not None and options.store_path:
            write_store(options.store_path, result.new_exact, result.entries, store_batch)
        session.range(1).select(F.lit(scan.total()).cast("bigint").alias("lines")).coalesce(1).write.mode(
            "overwrite").parquet(f"{out}/counts/batch={batch_id}")

    return (stream_lines(spark, path, max_files).writeStream.foreachBatch(batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _lines_before(spark: SparkSession, out: str, batch_id: int) -> int:
    """Lines in earlier batches: one row per batch."""
    earlier = [full for name, full, regular in listing(spark, f"{out}/counts")
               if not regular and name.startswith("batch=") and int(name[6:]) < batch_id]
    if not earlier:
        return 0
    return spark.read.parquet(*earlier).agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]


# --- tables kept by streams ---------------------------------------------------

def stream_reuse(events: DataFrame, store_path: str, out: str, checkpoint: str, max_similar: int = config.STORE_MAX_ENTRIES) -> StreamingQuery:
    """Exact reuse of whole verdicts while events arrive.

    ``events(canonical_key, context_type, context_family, line_number, verdict)``; the last column is the verdict that an event
    gets if it has to ask (that of the first event of its class in a batch counts). What is stored for a key is the store's; within a batch
    runs of events are reduced to maps from state to state and chained, so a key with any share of the rows is many tasks.
    ``<out>/batch=<n>`` gets (canonical_key, line_number, context_type, outcome, verdict, reused_type); a retried batch replaces it.
    """
    checkpoint_dir(events.sparkSession)

    def batch(arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        rows = cut_lineage(arrived.select(*CLASS, "line_number", "verdict"))
        classes = number_classes(rows.groupBy(*CLASS).agg(F.min("line_number").alias("first_line"), F.min_by("verdict", "line_number").alias("verdict")))
        exact, entries = read_store(spark, store_path, before_batch=batch_id + 1, keys=rows)
        known = cut_lineage(exact_lookup(classes, exact).withColumns({
            "accepted": F.lit(False), "verdict_type": attack_type_name(F.col("verdict.attack_type"))}))
        folded = fold_reuse(rows.drop("verdict"), known)
        used = F.when(F.col("state") > 0, F.col("state")).otherwise(F.col("class_no"))
        resolved = join_dealt(folded.withColumn("used", used), known.select(
            "canonical_key", F.col("class_no").alias("used"), "verdict", "exact_verdict"), ["canonical_key", "used"])
        hit = F.col("outcome") == "exact"
        verdict = F.when(hit & (F.col("state") == 0), F.col("exact_verdict")).otherwise(F.col("verdict"))
        resolved.select("canonical_key", "line_number", "context_type", "outcome", verdict.alias("verdict")).withColumn(
            "reused_type", F.when(F.col("outcome") == "exact", attack_type_name(F.col("verdict.attack_type")))).write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")
        asked = spark.read.parquet(f"{out}/batch={batch_id}").where("outcome = 'miss'")
        write_store(store_path, admit_exact(asked), entries.orderBy(F.col("seq").desc()).limit(max_similar), batch_id + 1)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(alerts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest alert per key in a bucketed table while alerts arrive; later batches win, within a batch
    later ``arrival``. A batch rewrites the buckets of its own keys; a retried one starts from the table before it."""
    checkpoint_dir(alerts.sparkSession)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        # earlier batches' rows are older whatever their arrival number
        fresh = batch.withColumns({"arrival_batch": F.lit(batch_id).cast("bigint"), "alert_key": alert_key()})

        def newest(rows: DataFrame) -> DataFrame:
            ordered = rows.withColumn("__order", F.struct("arrival_batch", "arrival"))
            return upsert(ordered.drop("alert_key"), "__order").select(*rows.columns)

        merge(fresh, out, "alert_key", batch_id, newest)

    return (alerts.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_upsert(spark: SparkSession, out: str) -> DataFrame:
    """The table of ``stream_upsert`` as of its last batch."""
    return read_merged(spark, out)


def stream_progress(spark: SparkSession, out: str) -> DataFrame:
    """``(batch, lines, processed)`` of the finished batches of an incremental run."""
    counts = spark.read.option("basePath", f"{out}/counts").parquet(f"{out}/counts/batch=*")
    # one row per batch
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("batch", "lines", F.sum("lines").over(upto).alias("processed"))
