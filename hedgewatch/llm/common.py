"""Shared helpers: ragged arrays, row batches, two-level ranks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch.session import cut_lineage

#: Characters of text that a task holds as Python words at a time (one longer text is held whole).
CHARS_AT_ONCE = 4_000_000


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer name that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def slices_of_texts(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts with at most ``most`` characters together, or one text."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def slices_of_lengths(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows with at most ``most`` together, or one row."""
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(lengths):
        yield begin, len(lengths)


class PieceCache:
    """Token ids of the pieces of text a task has met.

    Beyond ``most`` pieces those used once are dropped (all, if too many are left): a bound on memory, not on results.
    """

    def __init__(self, most: int):
        self.most = most
        self.known: dict = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.filled = 0

    def look_up(self, pieces: list, learn: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has. ``learn`` gives both for new pieces."""
        if len(self.known) > self.most:
            self._keep(2)
            if len(self.known) > self.most // 2:
                self._keep(1 << 62)
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing = [pieces[i] for i in unknown]
            fresh = list(dict.fromkeys(missing))
            self._add(fresh, *learn(fresh))
            at[unknown] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.lengths[at]
        return self.ids[ragged_index(self.starts[at], lengths)], lengths

    def _add(self, pieces: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(pieces)
        self.known.update(zip(pieces, range(first, last)))
        self.ids = grown(self.ids, self.filled + len(ids))
        self.starts, self.lengths, self.uses = (grown(a, last) for a in (self.starts, self.lengths, self.uses))
        self.ids[self.filled:self.filled + len(ids)] = ids
        self.starts[first:last] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.filled += len(ids)

    def _keep(self, least_uses: int) -> None:
        kept = [(p, i) for p, i in self.known.items() if self.uses[i] >= least_uses]
        at = np.array([i for _, i in kept], np.int64)
        lengths = self.lengths[at]
        ids = self.ids[ragged_index(self.starts[at], lengths)]
        most = self.most
        self.__init__(most)
        self._add([p for p, _ in kept], ids, lengths)


def grown(array: np.ndarray, least: int) -> np.ndarray:
    """``array``, or a longer copy with at least ``least`` elements."""
    if least <= len(array):
        return array
    larger = np.zeros(max(least, 2 * len(array)), array.dtype)
    larger[:len(array)] = array
    return larger


def split_sums(lengths: np.ndarray, parts: list[int]) -> np.ndarray:
    """Sums of ``lengths`` over consecutive runs of ``parts`` elements; runs may be empty."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return np.diff(ends[np.concatenate(([0], np.cumsum(parts, dtype=np.int64)))])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns added, or replaced where the name exists."""
    arrays = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def rank_within(df: DataFrame, keys: list[str], order: list[str], spread: list[str], name: str,
                rows: int | None = None) -> DataFrame:
    """``name``: place from 0 of each row among the rows of its key; ties in any order.

    A key may hold any share of the rows: they are dealt into about sqrt(rows)
    buckets by a hash of ``spread``, numbered in their bucket, and moved on by the rows of
    the earlier buckets. No task has more than sqrt(rows) rows of a key.
    """
    rows = df.count() if rows is None else rows
    buckets = max(1, int(rows ** 0.5))
    dealt = df.withColumn("_bucket", F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in spread)}), {buckets})"))
    by = [*keys, "_bucket"]
    before = (dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(
                  Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_rows"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return placed.join(before.hint("shuffle_hash"), by).withColumn(
        name, F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long; a row each).

    Returns (node, component): component is the smallest node reachable. Alternates
    large-star and small-star steps, each written to the shared checkpoint folder, until the edges stay the same.
    A node's neighbours are never gathered in a row: the steps are a minimum per node and a
    join, and the optimizer may split a hot node's side of it.
    """
    pairs = cut_lineage(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    for _ in range(rounds):
        both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: every larger neighbour of a node goes to the least of its neighbourhood.
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b")
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b AS a", "m AS b").unionByName(low.selectExpr("a", "m AS b"))
        after = cut_lineage(small.where("a <> b").distinct())
        same = (after.count() == pairs.count()
                and after.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
                == pairs.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        pairs = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.selectExpr("a AS node", "b AS component").unionByName(
        pairs.selectExpr("b AS node", "b AS component").distinct())
