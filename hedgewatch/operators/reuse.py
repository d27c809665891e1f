"""Verdict reuse: exact keys, top-1 similarity, the order-dependent part, the store.

Every decision depends on a request's canonical key and its context (attack type
and rule family), so lookups run once per distinct combination ("class"), not
once per event; a flooded key costs one lookup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.canonical import with_canonical_key
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.policy import (
    attack_type_name, context_type, exact_compatible, risk_score, rule_family,
    similarity_decision,
)
from hedgewatch.functions.verdict import confidence_value
from hedgewatch.session import cut_lineage

# ``embedder()`` is called once per partition and gives a function from a list
# of texts to as many vectors.
Embedder = Callable[[], Callable[[list[str]], list]]

MAX_STORE_BYTES = 256 * 1024 * 1024
# rows that meet a block of a store that is too large to broadcast
ROWS_AT_ONCE = 8192
# rows and entries of one matrix product: all that a task holds of the products
TILE = 1024, 2048
BUCKET_LINES = 1_000_000
# reason of a key that could not be embedded: it is asked for, and not admitted to the similarity entries
LOOKUP_FAILED = "lookup_failed"
CLASS = ["canonical_key", "context_type", "context_family"]


def with_context(df: DataFrame) -> DataFrame:
    """Add ``canonical_key``, ``context_type`` and ``context_family``."""
    keyed = with_canonical_key(df).withColumn("context_type", context_type(F.col("attack_types")))
    return keyed.withColumn(
        "context_family", rule_family(F.col("context_type"), F.col("matched_rules")))


def with_verdict_policy(df: DataFrame) -> DataFrame:
    """Add what the store keeps next to a verdict: ``cached_type``, ``confidence``,
    ``rule_family`` and ``risk_score``."""
    kind = attack_type_name(F.col("verdict.attack_type"))
    rules = F.col("matched_rules") if "matched_rules" in df.columns else F.lit(None).cast("array<string>")
    context_risk = F.col("risk_score") if "risk_score" in df.columns else F.lit(None)
    return df.withColumn("cached_type", kind).withColumns({
        "confidence": confidence_value(F.col("verdict.confidence")),
        "rule_family": rule_family(F.col("cached_type"), rules),
        "risk_score": risk_score(context_risk, F.col("verdict.risk_score"), F.col("verdict.severity")),
    })


# --- embeddings and the nearest stored verdict --------------------------------


class HashedNgrams:
    """Deterministic offline embedder: counts of character trigrams by hash (the
    first 28 bits of their MD5), unit length. ``embed_keys`` computes it in the JVM."""

    def __init__(self, dims: int = 256) -> None:
        self.dims = dims

    def embed(self, keys: DataFrame, text: Column) -> DataFrame:
        """``keys`` with ``embedding``. Counts and norm are columns of their own first, so that each is found once a row."""
        padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
        places = F.transform(grams, lambda g: F.conv(F.left(F.md5(g), F.lit(7)), 16, 10).cast("int") % self.dims)
        # (place, count) of the places that occur, in order: equal places stand together, so a count is how far the next begins
        starts = F.transform(F.array_distinct("__places"), lambda place: F.struct(
            place.alias("place"), F.array_position("__places", place).cast("int").alias("start")))
        counts = F.transform("__starts", lambda s, i: F.struct(s["place"], (F.coalesce(
            F.get("__starts", i + 1)["start"], F.size("__places") + 1) - s["start"]).alias("count")))
        norm = F.sqrt(F.aggregate("__counts", F.lit(0.0), lambda total, c: total + c["count"] * c["count"]))
        # the counts with the zeros before each of them, and those after the last
        zeros = F.transform("__counts", lambda c, i: F.concat(
            F.array_repeat(F.lit(0.0).cast("float"), c["place"] - F.coalesce(F.get("__counts", i - 1)["place"], F.lit(-1)) - 1),
            F.array((c["count"] / F.col("__norm")).cast("float"))))
        rest = F.array_repeat(F.lit(0.0).cast("float"), self.dims - 1 - F.element_at("__counts", -1)["place"])
        staged = keys
        for name, column in (("__places", F.array_sort(places)), ("__starts", starts), ("__counts", counts), ("__norm", norm)):
            staged = with_columns_once(staged, {name: column})
        return staged.withColumn("embedding", F.concat(F.flatten(zeros), rest)).drop("__places", "__starts", "__counts", "__norm")

    def __call__(self):
        from hashlib import md5

        def embed(texts: list[str]) -> list[np.ndarray]:
            out = np.zeros((len(texts), self.dims), dtype=np.float32)
            for row, text in enumerate(texts):
                padded = f" {text} "
                for i in range(max(1, len(padded) - 2)):
                    out[row, int(md5(padded[i:i + 3].encode()).hexdigest()[:7], 16) % self.dims] += 1
            return list(out)

        return embed


def embed_keys(keys: DataFrame, embedder: Embedder, truncate: int | None = None,
               batch_size: int = config.EMBED_BATCH) -> DataFrame:
    """Add ``embedding`` (float32, unit length, a zero vector stays zero) to rows of
    distinct ``canonical_key``. Only keys are embedded, in batches, in order, and whole;
    ``truncate`` is for an embedder that takes no more characters (``config.EMBED_MAX_CHARS``
    is a usual figure): keys that agree so far then count as one. A key whose embedding fails
    has no vector; only that key is concerned."""
    if isinstance(embedder, HashedNgrams):
        key = F.col("canonical_key") if truncate is None else F.left("canonical_key", F.lit(truncate))
        return embedder.embed(keys.drop("embedding"), key)
    kept = [f for f in keys.schema.fields if f.name != "embedding"]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for batch in batches:
            try:
                embed = embed or embedder()
            except Exception:  # no embedder, no vectors: the run goes on without similarity
                embed = None
            texts = [t[:truncate] for t in batch["canonical_key"]]
            vectors = []
            for start in range(0, len(texts), batch_size):
                for vector in _vectors(embed, texts[start:start + batch_size]):
                    if vector is not None:
                        vector = np.asarray(vector, dtype=np.float32)
                        norm = np.linalg.norm(vector)
                        vector = vector / norm if norm > 0 else vector
                    vectors.append(vector)
            yield batch[names].assign(embedding=vectors)

    return keys.mapInPandas(run, schema)


def _vectors(embed: Callable[[list[str]], list] | None, texts: list[str]) -> list:
    """As many vectors as texts; None for a text whose embedding fails."""
    try:
        vectors = list(embed(texts))
        if len(vectors) != len(texts):
            raise ValueError("another number of vectors than texts")
        return vectors
    except Exception:  # told by the reason ``lookup_failed`` of the keys concerned
        if len(texts) == 1:
            return [None]
        return [v for text in texts for v in _vectors(embed, [text])]


def _best_of(queries: np.ndarray, store: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``store`` of each query's largest product (the first of equals), and that product. Products
    are made a ``TILE`` at a time, so memory does not depend on how many queries meet how many entries."""
    rows, columns = TILE
    best, most = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), -np.inf)
    for start in range(0, len(queries), rows):
        part = slice(start, start + rows)
        place, value = best[part], most[part]
        for first in range(0, len(store), columns):
            products = queries[part] @ store[first:first + columns].T
            here = products.argmax(axis=1)
            found = products[np.arange(len(products)), here]
            # a product that is no number comes first, as in one argmax over the whole store
            better = (found > value) | (np.isnan(found) & ~np.isnan(value)) if first else np.ones(len(found), dtype=bool)
            place[better], value[better] = here[better] + first, found[better]
    return best, most


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix, without an object for each number."""
    lengths = vectors.value_lengths()
    if not len(vectors) or vectors.null_count or len(lengths.unique()) > 1:
        return np.array(vectors.to_pylist(), dtype=np.float64)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def top1(df: DataFrame, entries: DataFrame, max_bytes: int = MAX_STORE_BYTES) -> DataFrame:
    """Add ``best_seq`` and ``similarity`` of the stored entry with the largest dot
    product (the oldest of equals), both NULL for an empty store.

    A store of up to ``max_bytes`` of vectors is broadcast and met by matrix products of a
    ``TILE``; a larger one meets the rows in blocks, the same way.
    """
    spark = df.sparkSession
    rows, dims = entries.select(
        F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if rows * dims * 8 > max_bytes:
        return _top1_in_blocks(df, entries, rows, max(1, max_bytes // (8 * dims)))
    stored = entries.select("seq", "embedding").orderBy("seq").toArrow()
    shared = spark.sparkContext.broadcast((stored["seq"].to_numpy().astype(np.int64), _matrix(stored["embedding"].combine_chunks())))
    kept = [f for f in df.schema.fields if f.name not in ("best_seq", "similarity")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + \
        ", best_seq bigint, similarity double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seqs, store = shared.value
        for batch in batches:
            out = batch[names].copy()
            if len(seqs) and len(out):
                best, out["similarity"] = _best_of(np.array(batch["embedding"].tolist(), dtype=np.float64), store)
                out["best_seq"] = seqs[best]
            else:
                out["best_seq"] = pd.Series([None] * len(out), index=out.index, dtype="Int64")
                out["similarity"] = np.full(len(out), np.nan)
            yield out

    found = df.mapInPandas(run, schema)
    return found if rows else found.withColumn("similarity", F.lit(None).cast("double"))


def _top1_in_blocks(df: DataFrame, entries: DataFrame, stored: int, block: int) -> DataFrame:
    """Blocks of rows meet blocks of the store; a row's best is the best of its blocks. Only vectors and row numbers are shuffled for it."""
    kept = [c for c in df.columns if c not in ("best_seq", "similarity")]
    rows = cut_lineage(df.select(*kept).withColumn("__row", F.monotonically_increasing_id()))
    parts, groups = -(-stored // block), max(1, -(-rows.count() // ROWS_AT_ONCE))
    asked = rows.select("__row", "embedding").selectExpr(
        "__row", "embedding", f"pmod(xxhash64(__row), {groups}) AS g", f"explode(sequence(0, {parts - 1})) AS p")
    known = entries.selectExpr("seq", "embedding", f"CAST(pmod(xxhash64(seq), {parts}) AS INT) AS p", f"explode(sequence(0L, {groups - 1}L)) AS g")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"__row": pd.Series(dtype="int64"), "best_seq": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        right = right.sort_values("seq")
        best, similarity = _best_of(np.array(left["embedding"].tolist(), dtype=np.float64), np.array(right["embedding"].tolist(), dtype=np.float64))
        return pd.DataFrame({"__row": left["__row"].to_numpy(), "best_seq": right["seq"].to_numpy()[best], "similarity": similarity})

    found = asked.groupBy("g", "p").cogroup(known.groupBy("g", "p")).applyInPandas(meet, "__row bigint, best_seq bigint, similarity double")
    best = found.groupBy("__row").agg(F.max(F.struct("similarity", (-F.col("best_seq")).alias("older"))).alias("best")).select(
        "__row", (-F.col("best.older")).alias("best_seq"), F.col("best.similarity").alias("similarity"))
    return rows.join(best, "__row", "left").select(*kept, "best_seq", "similarity")


# --- lookup against a snapshot of the store -----------------------------------


def exact_lookup(df: DataFrame, exact: DataFrame, has_context: bool = True) -> DataFrame:
    """Join the verdict stored under the same key. ``exact`` has one row per
    ``canonical_key``. Adds ``exact_verdict``, ``exact_type`` and ``exact_ok``
    (NULL without a stored verdict, false if the context does not fit)."""
    stored = exact.select("canonical_key", F.col("verdict").alias("exact_verdict"),
                          attack_type_name(F.col("verdict.attack_type")).alias("exact_type"),
                          F.lit(True).alias("__stored"))
    joined = df.join(stored, "canonical_key", "left")
    context = F.col("context_type") if has_context else F.lit("unknown")
    return joined.withColumn("exact_ok", F.when(
        F.col("__stored"), exact_compatible(context, F.col("exact_type"), has_context))).drop("__stored")


def similarity_lookup(df: DataFrame, entries: DataFrame, has_context: bool = True) -> DataFrame:
    """For rows with an ``embedding``: the nearest entry and whether it may be used.
    Adds ``best_seq``, ``similarity``, ``cached_type``, ``near_verdict``,
    ``accepted``, ``reason``; ``accepted`` is false with reason ``empty_cache`` for an empty
    store."""
    near = entries.select(
        F.col("seq").alias("best_seq"), F.col("attack_type").alias("cached_type"),
        F.col("rule_family").alias("cached_family"), F.col("confidence").alias("cached_confidence"),
        F.col("verdict").alias("near_verdict"))
    # verdicts hold whole answers: their size is for the optimizer to judge
    found = top1(df, entries).join(near, "best_seq", "left")
    context = F.col("context_type") if has_context else F.lit("unknown")
    family = F.col("context_family") if has_context else F.lit("unknown")
    decided = found.withColumn("__decision", F.when(F.col("best_seq").isNotNull(), similarity_decision(
        F.col("cached_type"), F.col("cached_family"), F.col("cached_confidence"),
        F.col("similarity"), context, family, has_context)))
    return decided.withColumns({
        "accepted": F.coalesce(F.col("__decision.accepted"), F.lit(False)),
        "reason": F.coalesce(F.col("__decision.reason"), F.lit("empty_cache")),
    }).drop("__decision", "cached_family", "cached_confidence")


def lookup_classes(classes: DataFrame, exact: DataFrame, entries: DataFrame, embedder: Embedder,
                   has_context: bool = True) -> DataFrame:
    """Snapshot lookup per class: the exact join first, similarity for the keys it
    does not settle for all their contexts. Keys are embedded once each, however
    many contexts they occur in."""
    found = exact_lookup(classes, exact, has_context)
    open_keys = found.filter(~F.coalesce("exact_ok", F.lit(False))).select("canonical_key").distinct()
    if isinstance(embedder, HashedNgrams):  # short keys, much work on each: too few bytes to be dealt to all cores by size
        open_keys = open_keys.repartition(classes.sparkSession.sparkContext.defaultParallelism, "canonical_key")
    embedded = cut_lineage(found.join(embed_keys(open_keys, embedder), "canonical_key"))
    near = similarity_lookup(embedded.filter("embedding IS NOT NULL"), entries, has_context)
    nothing = {"best_seq": "bigint", "similarity": "double", "cached_type": "string", "reason": "string",
               "near_verdict": near.schema["near_verdict"].dataType, "embedding": "array<float>"}
    settled = found.join(open_keys, "canonical_key", "left_anti").withColumns({
        **{c: F.lit(None).cast(t) for c, t in nothing.items()}, "accepted": F.lit(False)})
    failed = embedded.filter("embedding IS NULL").withColumns({
        **{c: F.lit(None).cast(t) for c, t in nothing.items()}, "accepted": F.lit(False), "reason": F.lit(LOOKUP_FAILED)})
    return settled.unionByName(near).unionByName(failed)


def lookup_outcome(df: DataFrame) -> DataFrame:
    """``hit_type``, ``hit``, ``similarity``, ``cached_type``, ``reason``,
    ``policy_mode`` and ``rejects`` (how many checks turned the event down) from
    snapshot lookup columns."""
    exact = F.coalesce("exact_ok", F.lit(False))
    stored_unfit = F.coalesce(~F.col("exact_ok"), F.lit(False))
    semantic = ~exact & F.col("accepted")
    empty = F.col("reason").isin("empty_cache", LOOKUP_FAILED)
    return df.withColumns({
        "hit_type": F.when(exact, "exact").when(semantic, "semantic").when(empty, "miss").otherwise("rejected"),
        "hit": exact | semantic,
        "similarity": F.when(exact, F.lit(1.0)).otherwise(F.col("similarity")),
        "cached_type": F.when(exact, F.col("exact_type")).otherwise(F.col("cached_type")),
        "reason": F.when(exact, "exact_canonical_key").otherwise(F.col("reason")),
        "policy_mode": F.lit(config.POLICY_MODE),
        "rejects": stored_unfit.cast("int") + (~exact & ~semantic & ~empty).cast("int"),
    })


def reuse_stats(outcomes: DataFrame, store_size: Column | int = 0) -> DataFrame:
    """One row: lookups, hits, hit rate over lookups, rejects and store size."""
    size = store_size if isinstance(store_size, Column) else F.lit(store_size).cast("bigint")
    return outcomes.agg(
        F.count("*").alias("lookups"), F.count_if("hit").alias("hits"),
        F.coalesce(F.sum("rejects"), F.lit(0)).alias("semantic_rejects"),
    ).withColumns({
        "hit_rate": F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(0.0),
        "size": size,
    })


# --- order-dependent reuse inside a batch -------------------------------------


def previous_in_key(df: DataFrame, key: list[str], order: str, value: str, out: str,
                    bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """``lag(value)`` per ``key`` in ``order``, without ever sorting one key in one
    task: lag within (key, bucket of lines), then the last value of the previous
    bucket for each first row, from a table of one row per (key, bucket)."""
    bucketed = df.withColumn("__bucket", F.floor(F.col(order) / bucket_lines))
    part = [*key, "__bucket"]
    inside = Window.partitionBy(*part).orderBy(order)
    lagged = bucketed.withColumns({
        "__in_bucket": F.lag(F.struct(value)).over(inside),
    })
    ends = bucketed.groupBy(*part).agg(F.max_by(F.struct(value), order).alias("__last"))
    before = ends.withColumn(
        "__before", F.lag("__last").over(Window.partitionBy(*key).orderBy("__bucket"))
    ).drop("__last")
    joined = lagged.join(before, part, "left")
    found = F.coalesce(F.col("__in_bucket"), F.col("__before"))
    return joined.withColumn(out, found[value]).drop("__bucket", "__in_bucket", "__before")


def batch_exact_hits(df: DataFrame, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """``exact_hit`` within a batch for verdicts whose type equals their event's
    context type: an event reuses its key's last verdict exactly if the previous
    event of the key had the same context type."""
    previous = previous_in_key(df, ["canonical_key"], "line_number", "context_type",
                               "previous_type", bucket_lines)
    return previous.withColumn(
        "exact_hit", F.coalesce(F.col("previous_type") == F.col("context_type"), F.lit(False)))


#: Maps of states that are chained in one row.
CHAIN = 256


def _chained(maps: Column) -> Column:
    """The map of states that ``maps`` are one after the other; a map holds the next state of each state."""
    same = F.sequence(F.lit(0), F.size(F.get(maps, F.lit(0))) - 1)
    return F.aggregate(maps, same, lambda m, following: F.transform(m, lambda s: F.get(following, s)))


def _states_before(maps: Column, entry: Column) -> Column:
    states = F.aggregate(maps, F.array(entry), lambda seen, m: F.concat(seen, F.array(F.get(m, F.element_at(seen, -1)))))
    return F.slice(states, F.lit(1), F.size(maps))


def _gathered(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per ``keys`` its parts in the order of ``at``, and the map that they are together."""
    parts = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, "map"))).alias("parts"))
    return parts.withColumn("map", _chained(F.col("parts.map")))


def _entries(gathered: DataFrame, entries: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, entry): the state before each part, from the ``entry`` of its ``keys``."""
    states = _states_before(F.col("parts.map"), F.col("entry"))
    part = F.explode(F.arrays_zip(F.col(f"parts.{at}").alias(at), states.alias("entry")))
    return gathered.join(entries, keys).select(*keys, part.alias("part")).select(*keys, "part.*")


def join_dealt(events: DataFrame, few: DataFrame, keys: list[str], bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """Inner join of events with ``few`` (at most one row per key) that never brings all events of a key
    together: both sides meet per (key, bucket of lines), after ``few`` has been given the buckets its keys occur in."""
    dealt = events.withColumn("__bucket", F.floor(F.col("line_number") / bucket_lines))
    cells = dealt.select(*keys, "__bucket").distinct().join(few, keys)
    return dealt.join(cells, [*keys, "__bucket"]).drop("__bucket")


def number_classes(classes: DataFrame) -> DataFrame:
    """Add ``class_no``, the rank of a class by ``first_line`` within its key, and
    ``mixed``, whether the key has several. Classes per key are attack types times
    rule families, a constant."""
    per_key = Window.partitionBy("canonical_key")
    return classes.withColumns({
        "class_no": F.row_number().over(per_key.orderBy("first_line")),
        "mixed": F.count("*").over(per_key) > 1,
    })


def fold_reuse(events: DataFrame, classes: DataFrame, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """Replay reuse per key in line order.

    ``events``: class columns, ``line_number`` and any others, which are kept.
    ``classes``: one row per class
    from ``number_classes`` with ``first_line``, ``exact_ok``, ``accepted``
    (similarity) and ``verdict_type``, the type of the verdict the class gets if it
    has to ask. Adds ``class_no``, ``outcome`` (exact, semantic, miss) and
    ``state``: for an exact hit the class whose verdict is reused, 0 for the one in
    the store.

    The state of a key is the class whose verdict was stored last, so one event
    maps a state to a state, and so does any run of events. Keys with one class
    have a closed form. For the others each (key, bucket of lines) is reduced to
    such a map, maps are chained per key, ``CHAIN`` at a time, and buckets are
    replayed from their entry state: no row ever holds all events or all buckets
    of a key, and everything is columns.
    """
    known = classes.withColumns({
        "exact_ok": F.coalesce("exact_ok", F.lit(False)),
        "accepted": F.coalesce("accepted", F.lit(False)),
    })
    kept = events.columns
    tagged = join_dealt(events, known.select(
        *CLASS, "class_no", "mixed", "first_line", "exact_ok", "accepted", "verdict_type"), CLASS, bucket_lines)
    again = exact_compatible(F.col("context_type"), F.col("verdict_type"))

    asks = ~F.col("exact_ok") & ~F.col("accepted")
    repeats = asks & (F.col("line_number") != F.col("first_line")) & again
    single = tagged.filter(~F.col("mixed")).select(
        *kept, "class_no",
        F.when(F.col("exact_ok") | repeats, "exact").when(F.col("accepted"), "semantic")
        .otherwise("miss").alias("outcome"),
        F.when(repeats, F.col("class_no")).otherwise(F.lit(0)).alias("state"))

    mixed = tagged.filter("mixed").withColumn("bucket", F.floor(F.col("line_number") / bucket_lines))
    inside = Window.partitionBy("canonical_key", "bucket").orderBy("line_number")
    before = F.lag("class_no").over(inside)
    starts = mixed.withColumn("starts", before.isNull() | (before != F.col("class_no"))).withColumn(
        "island", F.sum(F.col("starts").cast("bigint")).over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))

    def next_state(fits: Column, state: Column, c: Column) -> Column:
        return F.when(fits | c["accepted"], state).otherwise(c["class_no"])

    every = known.filter("mixed").groupBy("canonical_key").agg(F.sort_array(F.collect_list(F.struct(
        "class_no", "context_type", "exact_ok", "accepted", "verdict_type"))).alias("every"))
    turns = F.transform("every", lambda c: F.concat(
        F.array(next_state(c["exact_ok"], F.lit(0), c)),
        F.transform(F.col("every"), lambda s: next_state(
            exact_compatible(c["context_type"], s["verdict_type"]), s["class_no"], c))))
    first = starts.filter("starts").select(
        "canonical_key", "bucket", F.floor((F.col("island") - 1) / CHAIN).alias("segment"), "island", "class_no")
    cells = first.select("canonical_key", "bucket").distinct().join(
        every.select("canonical_key", turns.alias("turns")), "canonical_key")
    segments = first.groupBy("canonical_key", "bucket", "segment").agg(
        F.sort_array(F.collect_list(F.struct("island", "class_no"))).alias("path")).join(cells, ["canonical_key", "bucket"])
    maps = F.transform("path", lambda p: F.get("turns", p["class_no"] - 1))
    buckets = _gathered(segments.withColumn("map", _chained(maps)), ["canonical_key", "bucket"], "segment").withColumn(
        "era", F.floor(F.col("bucket") / CHAIN))
    eras = _gathered(buckets, ["canonical_key", "era"], "bucket")
    whole = _gathered(eras, ["canonical_key"], "era")
    entry = whole.select("canonical_key", F.lit(0).alias("entry"))
    entry = _entries(whole, entry, ["canonical_key"], "era")
    entry = _entries(eras, entry, ["canonical_key", "era"], "bucket").drop("era")
    entry = _entries(buckets.drop("era"), entry, ["canonical_key", "bucket"], "segment")
    reached = F.explode(F.arrays_zip(
        F.col("path.island").alias("island"), _states_before(maps, F.col("entry")).alias("state")))
    states = segments.join(entry, ["canonical_key", "bucket", "segment"]).select(
        "canonical_key", "bucket", reached.alias("r")).select("canonical_key", "bucket", "r.*")

    replay = starts.join(states, ["canonical_key", "bucket", "island"]).join(
        every.select("canonical_key", F.col("every.verdict_type").alias("types")), "canonical_key")
    fits = F.coalesce(F.when(F.col("state") == 0, F.col("exact_ok")).otherwise(exact_compatible(
        F.col("context_type"), F.get("types", F.col("state") - 1))), F.lit(False))
    asks = ~fits & ~F.col("accepted")
    repeats = asks & ~F.col("starts") & again
    replayed = replay.select(
        *kept, "class_no",
        F.when(fits | repeats, "exact").when(F.col("accepted"), "semantic")
        .otherwise("miss").alias("outcome"),
        F.when(repeats, F.col("class_no")).when(fits, F.col("state")).otherwise(F.lit(0)).alias("state"))
    return single.unionByName(replayed)


# --- admission ----------------------------------------------------------------


def admit_exact(new_verdicts: DataFrame) -> DataFrame:
    """Exact rows of ``new_verdicts(canonical_key, verdict, line_number)``: the last
    verdict per key. Combines map-side, so a flooded key is no burden."""
    last = F.max_by(F.struct("verdict", "line_number"), "line_number")
    return new_verdicts.groupBy("canonical_key").agg(last.alias("l")).select(
        "canonical_key", "l.verdict", "l.line_number")


def admit_entries(entries: DataFrame, new_verdicts: DataFrame,
                  max_size: int = config.STORE_MAX_ENTRIES) -> DataFrame:
    """Similarity entries after admitting ``new_verdicts(canonical_key, verdict,
    line_number, embedding, matched_rules)``: only verdicts with a vector, a
    reusable type and enough confidence; the newest ``max_size`` stay."""
    last_seq = entries.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).scalar()
    fresh = with_verdict_policy(new_verdicts).filter(
        F.col("embedding").isNotNull()
        & ~F.col("cached_type").isin(*config.EXACT_ONLY_TYPES)
        & (F.col("confidence") >= config.MIN_REUSE_CONFIDENCE)
    ).select(
        "canonical_key", "embedding", "verdict", F.current_timestamp().alias("created_at"),
        F.col("cached_type").alias("attack_type"), "rule_family", "confidence", "risk_score",
        F.lit(0).cast("bigint").alias("hit_count"), (last_seq + F.col("line_number")).alias("seq"))
    return entries.unionByName(fresh).orderBy(F.col("seq").desc()).limit(max_size)


def count_hits(entries: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """Entries with ``hit_count`` raised by ``semantic_hits(seq)``."""
    hits = semantic_hits.groupBy("seq").agg(F.count("*").alias("__n"))
    return entries.join(hits, "seq", "left").withColumn(
        "hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0))).drop("__n")
