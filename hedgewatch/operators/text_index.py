"""Substring search over stored alerts without scanning them: a posting index of character trigrams.

Alerts are stored in blocks of rows, a folder each. A posting tells for a trigram and a block at which places of the block the
trigram occurs in the searched text. A search reads the postings of its own trigrams, opens the blocks where one place has them
all, and verifies the text of these rows, so it gives what the scan gives. Batches are added; a manifest, written last, makes
a batch visible, and a retried batch replaces itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hedgewatch.operators.search import filter_alerts, haystack
from hedgewatch.sources.files import exists, remove
from hedgewatch.sources.manifest import commit, read_manifest

#: Rows of a block: what a found block's task reads, and the longest list of places in a posting.
BLOCK_ROWS = 20_000
#: Rows of a part, at least: what a task deals and writes, however small the blocks in it are; blocks are numbered apart by so many a part.
PART_ROWS, MOST_BLOCKS = 50_000, 1 << 32
#: Folders that postings are dealt into by their trigram; so many blocks share a file of a folder.
BUCKETS, SLICE_BLOCKS = 64, 256
GRAM = 3


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _postings(block: pa.Table) -> pa.Table:
    """(__block, gram, places): the distinct trigrams of a block's texts, and at which places of the block each occurs."""
    texts, number = block["text"].to_pylist(), block["__block"][0].as_py()
    marks = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    place = np.repeat(block["__place"].to_numpy().astype(np.int64), [len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    alphabet, mark = np.unique(marks, return_inverse=True)
    size, most = len(alphabet), int(place.max(initial=0)) + 1
    if len(marks) < GRAM:
        return pa.table({"__block": pa.array([], pa.int64()), "gram": pa.array([], pa.string()), "places": pa.array([], pa.list_(pa.int32()))})
    inside = row[:-2] == row[2:]  # a trigram within one text
    gram = ((mark[:-2] * size + mark[1:-1]) * size + mark[2:])[inside]
    if size ** 3 * most < 1 << 63:  # trigram and place in one number
        gram, place = np.divmod(np.unique(gram * most + place[:-2][inside]), most)
    else:
        gram, place = np.unique(np.stack([gram, place[:-2][inside]]), axis=1)
    begins = np.flatnonzero(np.diff(gram, prepend=-1))
    letters, found = [chr(c) for c in alphabet], gram[begins].tolist()
    names = [letters[g // (size * size)] + letters[g // size % size] + letters[g % size] for g in found]
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(gram)), pa.int32()), pa.array(place, pa.int32()))
    return pa.table({"__block": pa.array([number] * len(names), pa.int64()), "gram": pa.array(names, pa.string()), "places": places})


def add_to_text_index(alerts: DataFrame, path: str, batch: int, dashboard: bool = False, block_rows: int = BLOCK_ROWS) -> None:
    """Store ``alerts`` as batch ``batch`` of the index at ``path``.

    Alerts are found once and written, then dealt to parts once, and a part is cut into blocks; tasks grow with the rows, not with the blocks.
    A block's postings come from its own group, and only these, not the texts, are shuffled
    again, by trigram and slice of blocks, so that a trigram of every row is many tasks.
    """
    spark = alerts.sparkSession
    base = read_manifest(spark, path, before=batch)
    folder = f"{path}/data/batch={batch}"
    alerts.write.mode("overwrite").parquet(f"{folder}/unordered")
    found = spark.read.schema(alerts.schema).parquet(f"{folder}/unordered")
    part_rows = max(block_rows, PART_ROWS)
    parts = max(1, -(-found.count() // part_rows))
    order = [c for c in ("session_id", "line_number") if c in alerts.columns]
    ranged = found.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else found.repartition(parts)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = ranged.withColumns({"__part": F.spark_partition_id().cast("bigint"), "__place": place}).withColumns({
        "__block": F.expr(f"__part * {MOST_BLOCKS} + __place DIV {block_rows}"), "__place": F.expr(f"CAST(__place % {block_rows} AS INT)")}).drop("__part")
    dealt.write.partitionBy("__block").mode("overwrite").parquet(f"{folder}/rows")
    remove(spark, f"{folder}/unordered")
    stored = spark.read.schema(dealt.schema).parquet(f"{folder}/rows")
    # dealt by block alone, which also serves the grouping by block
    texts = stored.select("__block", "__place", haystack(dashboard).alias("text")).repartition(parts, "__block")
    places = texts.groupBy("__block").applyInArrow(_postings, "__block bigint, gram string, places array<int>")
    slice_parts = max(1, SLICE_BLOCKS * block_rows // part_rows)
    slices = -(-parts // slice_parts)
    postings = places.withColumns({"batch": F.lit(batch), "__bucket": _bucket(F.col("gram")), "__slice": F.expr(f"__block DIV {MOST_BLOCKS * slice_parts}")})
    postings.repartition(min(BUCKETS * slices, 4096), "__bucket", "__slice").sortWithinPartitions("__bucket", "gram", "__block").drop(
        "__slice").write.partitionBy("__bucket").mode("overwrite").parquet(f"{folder}/postings")
    batches = sorted({*(base["batches"] if base else ()), batch})
    commit(spark, path, batch, {"batches": batches, "dashboard": dashboard, "schema": dealt.schema.json()},
           {f"data/batch={n}" for n in batches}, base)


def query_grams(text: str) -> list[str]:
    """Trigrams that cover ``text``: one beginning at every third character, and the last. Rows without them cannot hold it."""
    starts = [*range(0, len(text) - GRAM + 1, GRAM), len(text) - GRAM]
    return sorted({text[i:i + GRAM] for i in starts if i >= 0})


def blocks_of(spark: SparkSession, path: str, search: str) -> list[str] | None:
    """Folders of the blocks in which some row has all trigrams of ``search``; None where it has none to look up."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no finished batch in {path}")
    grams = query_grams(search)
    if not grams:
        return None
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    folders = [f"{path}/data/batch={n}/postings/__bucket={b}" for n in manifest["batches"] for b in buckets]
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return []
    met = spark.read.schema("batch int, __block bigint, gram string, places array<int>").parquet(*folders).where(F.col("gram").isin(*grams))
    shared = met.groupBy("batch", "__block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(grams)).where(
        F.size(F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0)), F.array_intersect)) > 0)
    return sorted(f"{path}/data/batch={r[0]}/rows/__block={r[1]}" for r in shared.select("batch", "__block").collect())  # at most all blocks


def search_index(spark: SparkSession, path: str, search: str, severity: list[str] | None = None,
                 attack_type: list[str] | None = None, ip: str | None = None) -> DataFrame:
    """What ``filter_alerts`` gives for all alerts added to the index. Texts of fewer than three characters are scanned for."""
    manifest = read_manifest(spark, path)
    folders = blocks_of(spark, path, search.lower())
    if folders is None:
        folders = [f"{path}/data/batch={n}/rows" for n in manifest["batches"]]
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return filter_alerts(rows.drop("__block", "__place"), severity, attack_type, ip, search, manifest["dashboard"])
