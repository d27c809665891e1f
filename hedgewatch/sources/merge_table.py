"""A table with one row per key that batches of rows are merged into, bucket by bucket.

A batch rewrites the buckets that its keys fall into, in a folder of its own; the manifest goes on naming the older folders
of all other buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.session import cut_lineage
from hedgewatch.sources.manifest import commit, read_manifest

BUCKETS = 32


def merge(arrivals: DataFrame, table: str, key: str, batch: int, newest: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge ``arrivals`` as batch ``batch``: ``newest`` reduces old and new rows to one a key.

    A retried batch starts from the table before it. Rows without key are one key.
    """
    spark = arrivals.sparkSession
    base = read_manifest(spark, table, before=batch)
    buckets = base["buckets"] if base else buckets
    named: dict[str, str] = dict(base["named"]) if base else {}
    fresh = cut_lineage(arrivals.withColumn("__bucket", F.expr(f"CAST(pmod(xxhash64(`{key}`), {buckets}) AS INT)")))
    touched = [r[0] for r in fresh.select("__bucket").distinct().collect()]  # at most all buckets
    old = [named[str(b)] for b in touched if str(b) in named]
    rows = fresh.drop("__bucket")
    if old:
        rows = rows.unionByName(spark.read.schema(arrivals.schema).parquet(*[f"{table}/{f}" for f in old]))
    merged = newest(rows).withColumn("__bucket", F.expr(f"CAST(pmod(xxhash64(`{key}`), {buckets}) AS INT)"))
    merged.hint("rebalance", "__bucket").write.partitionBy("__bucket").mode("overwrite").parquet(f"{table}/data/batch={batch}")
    named |= {str(b): f"data/batch={batch}/__bucket={b}" for b in touched}
    commit(spark, table, batch, {"buckets": buckets, "named": named}, set(named.values()), base)


def read_merged(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """The table as of its last batch."""
    manifest = read_manifest(spark, table)
    if manifest is None:
        raise FileNotFoundError(f"no finished batch in {table}")
    folders = [f"{table}/{f}" for f in sorted(set(manifest["named"].values()))]
    if not folders:
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*folders)
