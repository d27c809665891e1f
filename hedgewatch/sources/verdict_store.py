"""The verdict store: exact verdicts, one per key, and a bounded set of entries.

Layout: ``<path>/epoch=<n>/exact`` (a log-structured table) and ``.../entries/version=<id>``.
Writing a batch again replaces it, so a retried batch changes nothing; clearing
starts a new epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hedgewatch.functions.verdict import VERDICT
from hedgewatch.sources.files import exists, listing, remove
from hedgewatch.sources.keyed_runs import last_batch, read_all, read_keys, write_run

EXACT = T.StructType([
    T.StructField("canonical_key", T.StringType()),
    T.StructField("verdict", VERDICT),
    T.StructField("line_number", T.LongType()),
])
ENTRIES = T.StructType([
    T.StructField("canonical_key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("verdict", VERDICT),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("rule_family", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("hit_count", T.LongType()),
    T.StructField("seq", T.LongType()),
])


def _numbers(spark: SparkSession, path: str, prefix: str, written: bool = False) -> list[int]:
    """Numbers of the ``prefix=<n>`` folders in ``path``, finished writes only."""
    found = [(int(name.split("=", 1)[1]), full) for name, full, regular in listing(spark, path)
             if not regular and name.startswith(prefix + "=")]
    return sorted(n for n, full in found if not written or exists(spark, f"{full}/_SUCCESS"))


def _epoch(spark: SparkSession, path: str) -> str:
    return f"{path}/epoch={max(_numbers(spark, path, 'epoch'), default=0)}"


def read_store(spark: SparkSession, path: str, before_batch: int | None = None,
               keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(exact, entries)``: the latest verdict per key and the current entries.
    ``before_batch`` reads the store as it was before that batch, the last or the one to come.
    With ``keys(canonical_key)`` only their verdicts are looked for, in files that may hold them."""
    epoch = _epoch(spark, path)
    if keys is None:
        exact = read_all(spark, f"{epoch}/exact", EXACT, "canonical_key", before_batch)
    else:
        exact = read_keys(keys, f"{epoch}/exact", EXACT, "canonical_key", before_batch)
    versions = [n for n in _numbers(spark, f"{epoch}/entries", "version", written=True) if before_batch is None or n < before_batch]
    entries = (spark.read.schema(ENTRIES).parquet(f"{epoch}/entries/version={versions[-1]}")
               if versions else spark.createDataFrame([], ENTRIES))
    return exact, entries


def next_batch(spark: SparkSession, path: str) -> int:
    return last_batch(spark, f"{_epoch(spark, path)}/exact") + 1


def _write_entries(entries: DataFrame, epoch: str, batch: int) -> None:
    entries.select(*ENTRIES.names).coalesce(1).write.partitionBy("attack_type").mode(
        "overwrite").parquet(f"{epoch}/entries/version={batch}")


def write_store(path: str, new_exact: DataFrame, entries: DataFrame, batch: int) -> None:
    """Add the exact verdicts of one batch, at most one per key, and write the entries as of it.
    ``entries`` must not read the version being written."""
    spark = new_exact.sparkSession
    epoch = _epoch(spark, path)
    _write_entries(entries, epoch, batch)
    write_run(new_exact.select(*EXACT.names), f"{epoch}/exact", "canonical_key", batch)
    # a retry of this batch starts from the version before it
    for n in [n for n in _numbers(spark, f"{epoch}/entries", "version") if n < batch][:-1]:
        remove(spark, f"{epoch}/entries/version={n}")


def clear_store(spark: SparkSession, path: str) -> None:
    """Forget every stored verdict: a new epoch with an empty version."""
    numbers = _numbers(spark, path, "epoch")
    epoch = f"{path}/epoch={max(numbers, default=0) + 1}"
    spark.createDataFrame([], ENTRIES).write.mode("overwrite").parquet(f"{epoch}/entries/version=0")


def compact_store(spark: SparkSession, path: str) -> None:
    """Rewrite the exact verdicts as one run of a new epoch, with the entries."""
    exact, entries = read_store(spark, path)
    batch = next_batch(spark, path) - 1
    epoch = f"{path}/epoch={max(_numbers(spark, path, 'epoch'), default=0) + 1}"
    _write_entries(entries, epoch, batch)
    write_run(exact, f"{epoch}/exact", "canonical_key", batch)
