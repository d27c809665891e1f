"""A log-structured table with one row per key.

Every batch is written as a run: its rows by bucket of the key's hash, with a Bloom filter for each bucket. Once a tier has
``FANOUT`` runs they are merged into one run of the next tier, so a row is rewritten once a tier, and a key is looked for
in a handful of runs. A lookup asks the filters first and opens only the buckets of those runs that may hold one of its keys.

Filters are rows (bucket, word, bits) rather than arrays: keys meet them by an equi-join, and no task holds a whole filter.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.sources.manifest import batches, commit, read_manifest

#: Buckets of a new table, runs of a tier that are merged.
BUCKETS, FANOUT = 16, 4
#: Bits of a filter for each key, bits set for a key, and the smallest and largest filter (as powers of two: at the largest a filter still
#: never misses a key, it only lets more pass).
BITS_PER_KEY, HASHES, LEAST_POWER, MOST_POWER = 12, 4, 10, 26
_FILTER = "bucket int, power int, word bigint, bits bigint"


def _bucket(key: str, buckets: int) -> Column:
    return F.expr(f"CAST(pmod(xxhash64(`{key}`), {buckets}) AS INT)")


def _places(keys: DataFrame, key: str) -> DataFrame:
    """The word and bit of each of a key's hashes in a filter of 2^power bits; ``keys`` has key, bucket and power."""
    place = [f"xxhash64(`{key}`, {i}) & (shiftleft(1L, power) - 1)" for i in range(1, HASHES + 1)]
    return keys.withColumn("place", F.explode(F.expr(f"array_distinct(array({', '.join(place)}))"))).selectExpr(
        f"`{key}`", "bucket", "power", "shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")


def _write_run(rows: DataFrame, table: str, folder: str, key: str, buckets: int, tier: int) -> dict:
    """Write ``rows`` (distinct keys) and its filters; what the manifest says of the run."""
    spark = rows.sparkSession
    dealt = rows.withColumn("bucket", _bucket(key, buckets))
    # Rebalancing splits large buckets into several files and keeps small ones together.
    dealt.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/{folder}/rows")
    written = spark.read.schema(dealt.schema).parquet(f"{table}/{folder}/rows")
    counts = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}  # a row a bucket
    powers = {b: min(MOST_POWER, max(LEAST_POWER, math.ceil(math.log2(BITS_PER_KEY * n)))) for b, n in counts.items()}
    if powers:
        power = F.element_at(F.create_map(*[F.lit(v) for p in powers.items() for v in p]), F.col("bucket"))
        _places(written.select(key, "bucket", power.alias("power")), key).groupBy("bucket", "power", "word").agg(
            F.bit_or("bit").alias("bits")).write.mode("overwrite").parquet(f"{table}/{folder}/filter")
    return {"folder": folder, "tier": tier, "rows": sum(counts.values()), "powers": {str(b): p for b, p in sorted(powers.items())}}


def _newest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns, "__batch"), "__batch").alias("r")).select(key, "r.*")


def write_run(rows: DataFrame, table: str, key: str, batch: int, buckets: int = BUCKETS) -> None:
    """Add ``rows``, at most one a key, as batch ``batch``; they hide earlier rows of their keys. Writing a batch again replaces it and what came
    after it."""
    spark = rows.sparkSession
    base = read_manifest(spark, table, before=batch)
    buckets = base["buckets"] if base else buckets
    runs = list(base["runs"]) if base else []
    columns = [c for c in rows.columns if c != key]
    kinds = T.StructType([*rows.schema, T.StructField("__batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    runs.append(_write_run(rows.withColumn("__batch", F.lit(batch).cast("bigint")), table, f"data/run={batch}-0", key, buckets, 0))
    tier = 0
    while sum(r["tier"] == tier for r in runs) >= FANOUT:
        merged = [r for r in runs if r["tier"] == tier]
        together = reduce(DataFrame.unionByName, [spark.read.schema(kinds).parquet(f"{table}/{r['folder']}/rows") for r in merged]).drop("bucket")
        runs = [r for r in runs if r["tier"] != tier]
        tier += 1
        runs.append(_write_run(_newest(together, key, columns), table, f"data/run={batch}-{tier}", key, buckets, tier))
    commit(spark, table, batch, {"buckets": buckets, "runs": runs}, {r["folder"] for r in runs}, base)


def folders_for(keys: DataFrame, table: str, key: str, before: int | None = None) -> list[str]:
    """The folders that may hold one of ``keys``: one for each run and bucket whose filter lets one pass."""
    spark = keys.sparkSession
    manifest = read_manifest(spark, table, before)
    runs = [r for r in manifest["runs"] if r["powers"]] if manifest else []
    if not runs:
        return []
    powers = sorted({p for r in runs for p in r["powers"].values()})
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("bucket", _bucket(key, manifest["buckets"]))
    places = _places(asked.withColumn("power", F.explode(F.array(*map(F.lit, powers)))), key)
    filters = reduce(DataFrame.unionByName, [spark.read.schema(_FILTER).parquet(f"{table}/{r['folder']}/filter").withColumn("run", F.lit(i))
                                             for i, r in enumerate(runs)])
    # A key may be in a run if all its bits are set there.
    wanted = places.groupBy(key, "bucket", "power").agg(F.count(F.lit(1)).alias("wanted"))
    passed = places.join(filters, ["bucket", "power", "word"]).where("(bits & bit) <> 0").groupBy("run", key, "bucket", "power").agg(
        F.count(F.lit(1)).alias("found")).join(wanted, [key, "bucket", "power"]).where("found = wanted")
    pairs = passed.select("run", "bucket").distinct().collect()  # at most buckets times runs
    return sorted(f"{runs[r['run']]['folder']}/rows/bucket={r['bucket']}" for r in pairs)


def read_keys(keys: DataFrame, table: str, schema: T.StructType, key: str, before: int | None = None) -> DataFrame:
    """The newest row of each of ``keys`` that the table has; opens no folder that can have none of them."""
    spark = keys.sparkSession
    folders = folders_for(keys, table, key, before)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema, T.StructField("__batch", T.LongType())])).parquet(*[f"{table}/{f}" for f in folders])
    columns = [c for c in schema.names if c != key]
    return _newest(rows.join(keys.select(key).distinct(), key, "left_semi"), key, columns).select(*schema.names)


def read_all(spark: SparkSession, table: str, schema: T.StructType, key: str, before: int | None = None) -> DataFrame:
    """The newest row of every key."""
    manifest = read_manifest(spark, table, before)
    runs = [r for r in manifest["runs"] if r["rows"]] if manifest else []
    if not runs:
        return spark.createDataFrame([], schema)
    kinds = T.StructType([*schema, T.StructField("__batch", T.LongType())])
    rows = reduce(DataFrame.unionByName, [spark.read.schema(T.StructType([*kinds, T.StructField("bucket", T.IntegerType())])).parquet(
        f"{table}/{r['folder']}/rows").drop("bucket") for r in runs])
    return _newest(rows, key, [c for c in schema.names if c != key]).select(*schema.names)


def last_batch(spark: SparkSession, table: str) -> int:
    return max(batches(spark, table), default=0)
