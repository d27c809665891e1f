"""Shards from a consistent-hash ring with virtual nodes and bounded loads. DataFrame and SQL functions only.

Every shard has ``points`` places on a ring of 2^32; a key belongs to the next place clockwise. A shard takes at most its
part of all rows (counts differ by one at most); keys that find it full go on clockwise to the next shards that have room.
Rows are only counted per place: which of a place's rows stay and where the others go follows from these counts, a table as
large as the ring, and each row finds its shard and slot from its rank among the rows of its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgewatch.llm.common import quoted
from hedgewatch.session import cut_lineage

SHARDS, POINTS = 24, 128
#: The ring is cut in so many arcs, so that a key is compared with the few places of its arc.
ARC_BITS = 12
RING_BITS = 32
#: Rows that nothing tells apart are written by a task in runs of so many at most.
COPIES_AT_ONCE = 1 << 16


def position(text: str) -> str:
    """SQL of a string's place on the ring."""
    return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS BIGINT)"


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """(place, position, shard, onward): places numbered clockwise; ``onward`` lists the shards met from there on, each once."""
    if shards < 1 or points < 1:
        raise ValueError("a ring needs a shard and a point")
    nodes = spark.range(shards * points).selectExpr(f"CAST(id % {shards} AS INT) AS shard", f"CAST(id DIV {shards} AS INT) AS point")
    placed = nodes.withColumn("position", F.expr(position("concat_ws(':', 'shard', shard, point)")))
    one = placed.agg(F.sort_array(F.collect_list(F.struct("position", "shard", "point"))).alias("ring"))
    numbered = one.selectExpr("transform(ring, x -> x.shard) AS shards", "posexplode(ring) AS (place, node)")
    onward = "array_distinct(concat(slice(shards, place + 1, size(shards)), slice(shards, 1, place)))"
    return numbered.selectExpr("CAST(place AS BIGINT) AS place", "node.position AS position", "node.shard AS shard", f"{onward} AS onward")


def arcs(places: DataFrame) -> DataFrame:
    """(arc, low, high, place): the keys low < key <= high of an arc belong to the place."""
    step = RING_BITS - ARC_BITS
    before = Window.orderBy("position", "place")  # as many rows as the ring has places
    reach = places.select("place", "position", F.lag("position", 1, -1).over(before).alias("low"))
    first = places.agg(F.min(F.struct("position", "place")).alias("m"), F.max("position").alias("last")).selectExpr(
        "m.place AS place", f"{1 << RING_BITS}L - 1 AS position", "last AS low")
    spans = reach.unionByName(first).where("low < position")
    return spans.selectExpr("place", "low", "position AS high",
                            f"explode(sequence(shiftright(low + 1, {step}), shiftright(position, {step}))) AS arc")


def loads(counts: DataFrame, places: DataFrame, shards: int, rows: int) -> DataFrame:
    """(place, first, last, shard, slot): of a place's rows, those ranked first..last - 1 go to ``shard`` from ``slot`` on.

    First every shard takes rows of its own places, clockwise, up to its bound; then what is left at each place goes on
    clockwise. No row can be left over: the bounds add up to the rows.
    """
    bound = f"CAST({rows // shards} + CAST(shard < {rows % shards} AS INT) AS BIGINT)"
    own = (places.join(counts, "place", "left").withColumn("n", F.coalesce("n", F.lit(0)))
           .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("place").rowsBetween(
               Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("kept", F.expr(f"greatest(0L, least(n, {bound} - before))")))
    free = own.groupBy("shard").agg(F.expr(f"first({bound}) - sum(kept)").alias("free"))
    room = free.agg(F.expr("transform(sort_array(collect_list(struct(shard, free))), x -> x.free)").alias("free"))
    over = own.where("n > kept").agg(F.expr(
        "sort_array(collect_list(struct(place, kept, n - kept AS left, onward)))").alias("places"))
    step = """aggregate(p.onward, named_struct('left', p.left, 'from', p.kept, 'free', s.free, 'out', s.out), (t, shard) ->
        CASE WHEN least(t.left, element_at(t.free, shard + 1)) <= 0 THEN t ELSE named_struct(
            'left', t.left - least(t.left, element_at(t.free, shard + 1)),
            'from', t.from + least(t.left, element_at(t.free, shard + 1)),
            'free', transform(t.free, (f, i) -> IF(i = shard, f - least(t.left, f), f)),
            'out', concat(t.out, array(named_struct('place', p.place, 'first', t.from,
                'last', t.from + least(t.left, element_at(t.free, shard + 1)), 'shard', shard)))) END,
        t -> named_struct('free', t.free, 'out', t.out))"""
    runs = "CAST(array() AS ARRAY<STRUCT<place: BIGINT, first: BIGINT, last: BIGINT, shard: INT>>)"
    both = room.selectExpr("free", "NULL AS places").unionByName(over.selectExpr("NULL AS free", "places")).agg(
        F.max_by("free", F.col("free").isNotNull()).alias("free"), F.max_by("places", F.col("places").isNotNull()).alias("places"))
    moved = both.select(F.expr(
        f"inline(aggregate(places, named_struct('free', free, 'out', {runs}), (s, p) -> {step}, s -> s.out))"))
    every = own.where("kept > 0").selectExpr("place", "0L AS first", "kept AS last", "shard", "0 AS turn").unionByName(
        moved.withColumn("turn", F.lit(1)))
    return every.withColumn("slot", F.coalesce(F.sum(F.expr("last - first")).over(
        Window.partitionBy("shard").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("turn")


def assign_shards(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard): every document's shard and its place in it, gapless from 0.

    ``size`` is the text's UTF-8 bytes plus 8; null text counts as none. Shards hold equally many documents, or one more.
    Rows without doc_id share one key, and so do repeated rows: what does not fit in their shard goes on like any other key.
    Which rows of an overfull place move on, a hash of what they hold decides, however the table is partitioned. ``home_shard`` is the ring's own choice. An empty table gives no rows.
    """
    spark = docs.sparkSession
    step = RING_BITS - ARC_BITS
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")).selectExpr(
        "doc_id", "CAST(coalesce(octet_length(text), 0) + 8 AS BIGINT) AS size", "crc32(coalesce(text, '')) AS text_crc32",
        f"{position('coalesce(CAST(doc_id AS STRING), '+repr('')+')')} AS position")
    places = cut_lineage(ring(spark, shards, points))
    near = F.broadcast(arcs(places))  # the ring's places and arcs: a size given by the arguments
    located = rows.withColumn("arc", F.shiftright("position", step)).join(near, "arc").where(
        "position > low AND position <= high")
    # rows that nothing tells apart are one entry with a count, so the ranks of all rows follow from what they hold
    entries = cut_lineage(located.groupBy("place", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    counts = cut_lineage(entries.groupBy("place").agg(F.sum("copies").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = F.broadcast(loads(counts, places, shards, total).withColumnRenamed("place", "of"))  # at most twice the ring's places, and a row a shard
    ranked = _ranked(entries, total).join(runs, F.expr("place = of AND rank < last AND rank + copies > first")).selectExpr(
        "doc_id", "size", "text_crc32", "place", "shard", "slot - first AS ahead", "greatest(rank, first) AS low", "least(rank + copies, last) AS high")
    home = F.broadcast(places.select(F.col("place").alias("at"), F.col("shard").alias("home_shard")))
    many = ranked.where(f"high - low > {COPIES_AT_ONCE}").withColumn("start", F.expr(f"explode(sequence(low, high - 1, {COPIES_AT_ONCE}L))"))
    dealt = many.withColumns({"low": F.col("start"), "high": F.expr(f"least(high, start + {COPIES_AT_ONCE})")}).drop("start").repartition("doc_id", "low")
    return (ranked.where(f"high - low <= {COPIES_AT_ONCE}").unionByName(dealt).withColumn("rank", F.expr("explode(sequence(low, high - 1))"))
            .join(home, F.expr("place = at"))
            .selectExpr("doc_id", "size", "text_crc32", "shard", "ahead + rank AS slot", "home_shard"))


def _ranked(entries: DataFrame, rows: int) -> DataFrame:
    """``rank``: how many rows of an entry's place come before it. A place's entries are dealt into about sqrt(rows) buckets by a
    hash of what they hold, summed up in their bucket, and moved on by the rows of the earlier buckets."""
    dealt = entries.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, text_crc32, size), {max(1, int(rows ** 0.5))})"))
    before = dealt.groupBy("place", "bucket").agg(F.sum("copies").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("place", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("within", F.coalesce(F.sum("copies").over(own), F.lit(0)))
    return within.join(before.drop("n").hint("shuffle_hash"), ["place", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")
