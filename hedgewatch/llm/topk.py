"""Exact top-k inner products with a KD-tree per shard.

Space is cut into cells by median splits of a bounded sample; the vectors of a cell are one shard, or several of bounded size. Each
shard builds a KD-tree (median splits along the widest side, tight bounding boxes) and is written as one row. Queries come in blocks
of bounded size that lie together; a block searches a shard of its own part of space first, which gives each query a k-th score.
The bounds of a block and of a shard then tell, before either is sent, whether they must meet; the k-th scores travel with the block. A search descends the tree with the largest inner product that a
box allows, visits a query's leaves best first, and ends when no box can beat the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch.llm.common import quoted
from hedgewatch.session import cut_lineage

SCALE, K = 64, 20
#: Vectors of a shard, of a leaf, and queries of a block: bounds on a task's memory.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 4096, 256, 2048
#: Boxes that tell for a block of queries which shards it must meet (a power of two).
BOXES = 16
#: Vectors that the cuts of space are fitted on, about, and the most cuts one below the other (a bound on broadcasts, not on results).
SAMPLE_ROWS, MOST_CUTS = 16_384, 12
_NONE = np.iinfo(np.int64).min
_SAFE = float(1 << 53)  # integers up to here are exact in double precision


def integer_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): components floor(scale * x) as doubles. Vectors that are null, empty, or hold null or non-finite
    components are left out; so are rows without vec_id."""
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), F.transform(
        quoted(vector_col), lambda x: x.cast("double")).alias("x"))
    usable = rows.where("vec_id IS NOT NULL AND size(x) > 0").where(
        ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    # The built-in floor of a double is a long; from 2^52 on a double is whole already.
    return usable.select("vec_id", F.transform("x", lambda v: F.when(
        F.abs(v * scale) < float(1 << 52), F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("vector"))


class Tree:
    """A KD-tree in arrays: rows of a node are ``start[i]:end[i]``, its children ``2i + 1`` and ``2i + 2``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        depth = 0
        while len(ids) > leaf << depth:
            depth += 1
        count = (2 << depth) - 1
        order = np.arange(len(ids))
        start, end = np.zeros(count, np.int64), np.zeros(count, np.int64)
        end[0] = len(ids)
        for node in range((1 << depth) - 1):
            a, b = start[node], end[node]
            own = order[a:b]
            middle = len(own) // 2
            if len(own) > 1:
                values = rows[own]
                axis = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
                order[a:b] = own[np.argpartition(values[:, axis], middle)]
            start[2 * node + 1], end[2 * node + 1] = a, a + middle
            start[2 * node + 2], end[2 * node + 2] = a + middle, b
        self.ids, self.rows, self.start, self.end = ids[order], rows[order], start, end
        self.first_leaf = (1 << depth) - 1
        full = [(self.rows[a:b].min(axis=0), self.rows[a:b].max(axis=0)) if b > a else (np.full(rows.shape[1], np.inf), np.full(rows.shape[1], -np.inf))
                for a, b in zip(start, end, strict=True)]
        self.low, self.high = (np.array([f[i] for f in full]) for i in (0, 1))

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The largest inner product that a point of each node's box can have with each query; empty boxes have none."""
        empty = self.start[nodes] == self.end[nodes]
        low, high = np.where(empty[:, None], 0, self.low[nodes]), np.where(empty[:, None], 0, self.high[nodes])
        found = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        found[:, empty] = -np.inf
        return found

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row id, score) of each query's best k rows here that reach ``least``; never rows of the query's own id."""
        best = np.full((len(ids), k), _NONE, np.int64)
        best_ids = np.zeros((len(ids), k), np.int64)
        least = least.copy()
        nodes, alive = np.array([0]), np.ones((len(ids), 1), bool)
        while len(nodes) and nodes[0] < self.first_leaf:  # what a level rules out has no children
            below = np.concatenate([2 * nodes + 1, 2 * nodes + 2])
            alive = np.concatenate([alive, alive], axis=1) & (self.bounds(queries, below) >= least[:, None])
            kept = alive.any(axis=0)
            nodes, alive = below[kept], alive[:, kept]
        bounds = np.where(alive, self.bounds(queries, nodes), -np.inf)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for turn in range(len(nodes)):  # every query's next best leaf
            leaf = order[:, turn]
            bound = bounds[np.arange(len(ids)), leaf]
            going = np.flatnonzero((bound >= least) & (bound > -np.inf))
            if not len(going):
                break
            for at in np.unique(leaf[going]):
                who = going[leaf[going] == at]
                self._visit(nodes[at], who, ids, queries, best, best_ids, k)
                kth = best[who, -1]
                least[who] = np.maximum(least[who], np.where(kth > _NONE, _rounded_down(kth), -np.inf))
        row, place = np.nonzero(best > _NONE)
        return row, best_ids[row, place], best[row, place]

    def _visit(self, node: int, who: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: np.ndarray, best_ids: np.ndarray, k: int) -> None:
        own = slice(self.start[node], self.end[node])
        names = self.ids[own]
        scores = products(queries[who], self.rows[own])
        scores[ids[who][:, None] == names[None, :]] = _NONE
        need = best[who, -1]
        if scores.shape[1] > k and (need == _NONE).any():
            need = np.maximum(need, np.partition(scores, -k, axis=1)[:, -k])
        i, j = np.nonzero((scores >= need[:, None]) & (scores > _NONE))
        old_i, old_j = np.nonzero(best[who] > _NONE)
        i, score, name = (np.concatenate(x) for x in ((old_i, i), (best[who][old_i, old_j], scores[i, j]), (best_ids[who][old_i, old_j], names[j])))
        order = np.lexsort((name, -score, i))  # scores are above the least long, so their negatives fit
        i, score, name = i[order], score[order], name[order]
        first = np.searchsorted(i, np.arange(len(who)))
        place = np.arange(len(i)) - first[i]
        kept = place < k
        best[who[i[kept]], place[kept]], best_ids[who[i[kept]], place[kept]] = score[kept], name[kept]


def _rounded_down(values: np.ndarray) -> np.ndarray:
    """As doubles, never above the integers: a bound must not rule out an equal score. Bounds beyond 2^51 round too, hence the margin."""
    exact = values.astype(np.float64)
    return np.where(np.abs(exact) < _SAFE / 4, exact, exact - np.abs(exact) * 1e-9)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products as longs; beyond the range of longs the nearest long."""
    if not rows.size or np.abs(queries).sum(axis=1).max(initial=0) * np.abs(rows).max(initial=0) < _SAFE:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(v) for v in q] for q in queries], [[int(v) for v in r] for r in rows]
    most = np.iinfo(np.int64).max
    return np.array([[max(_NONE + 1, min(most, sum(a * b for a, b in zip(q, r, strict=True)))) for r in whole[1]] for q in whole[0]], np.int64)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), lengths[0])
    rows = np.zeros((len(lengths), lengths.max(initial=0)))
    rows[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return rows


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


_TREE = "shard int, width bigint, ids binary, points binary, starts binary, ends binary, low binary, high binary"
_BLOCK = "block int, seed int, queries binary, query_width bigint, query_points binary, least binary"
_FOUND = "found binary, found_ids binary, found_scores binary"
_REACH = "boxes array<struct<block_low:array<double>,block_high:array<double>,weakest:double>>"


def cuts_of(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of ``2 ** depth - 1`` median cuts, those of the halves of cut i at 2i + 1 and 2i + 2."""
    axes, values = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: rows}
    for node in range(len(axes)):
        own = parts.pop(node)
        if len(own):
            axes[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            values[node] = np.median(own[:, axes[node]])
        below = own[:, axes[node]] < values[node] if own.shape[1] else np.zeros(len(own), bool)
        parts[2 * node + 1], parts[2 * node + 2] = own[below], own[~below]
    return axes, values


def with_cell(rows: DataFrame, axes: np.ndarray, values: np.ndarray) -> DataFrame:
    """(vec_id, vector, row, cell) of (vec_id, vector, row); a vector that ends before an axis is zero there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"))
            points = _wide(points, max(points.shape[1], int(axes.max(initial=-1)) + 1))
            node = np.zeros(len(points), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] >= values[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((node - len(axes)).astype(np.int32))], names=["vec_id", "vector", "row", "cell"])

    depth = len(axes).bit_length()
    return rows.mapInArrow(place, "vec_id bigint, vector array<double>, row bigint, cell int")


def parted(rows: DataFrame, cell: str, most: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` with a number ``name``: those of a ``cell`` have one number, or several where they are more than ``most``. With it the
    first number of every cell that has rows. A cell's rows are dealt by a hash of their row number, whatever they hold."""
    counts = sorted((r["cell"], r["n"]) for r in rows.groupBy(F.expr(cell).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, parts = {}, []
    for at, n in counts:  # at most 2 ** MOST_CUTS cells
        first[at] = parts[-1][1] + parts[-1][2] if parts else 0
        parts.append((at, first[at], -(-n // most)))
    known = rows.sparkSession.createDataFrame(parts, "at int, start int, parts int")
    number = "CAST(start + pmod(xxhash64(row), parts) AS INT)"
    return rows.join(F.broadcast(known), F.expr(f"{cell} = at")).withColumn(name, F.expr(number)).drop("at", "start", "parts"), first


def trees(rows: DataFrame, leaf: int = LEAF_ROWS) -> DataFrame:
    """A KD-tree per shard, as a row of arrays, of (shard, vec_id, vector)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("own").slice(i, 1).flatten()
                tree = Tree(own.field("vec_id").to_numpy(zero_copy_only=False), _matrix(own.field("vector")), leaf)
                blobs = (tree.ids, tree.rows, tree.start, tree.end, tree.low, tree.high)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(i, 1), pa.array([tree.rows.shape[1]], pa.int64()),
                     *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], names=names)

    names = [c.split(" ")[0] for c in _TREE.split(", ")]
    return rows.groupBy("shard").agg(F.collect_list(F.struct("vec_id", "vector")).alias("own")).mapInArrow(build, _TREE)


def query_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of queries as rows of arrays, of (block, seed, vec_id, vector); every k-th score is still open."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("own").slice(i, 1).flatten()
                points = _matrix(own.field("vector"))
                blobs = own.field("vec_id").to_numpy(zero_copy_only=False), points, np.full(len(points), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(i, 1), batch.column("seed").slice(i, 1), pa.array([blobs[0].tobytes()], pa.binary()),
                     pa.array([points.shape[1]], pa.int64()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs[1:]]], names=names)

    names = [c.split(" ")[0] for c in _BLOCK.split(", ")]
    return rows.groupBy("block", "seed").agg(F.collect_list(F.struct("vec_id", "vector")).alias("own")).mapInArrow(build, _BLOCK)


def _boxes(queries: np.ndarray, least: np.ndarray) -> list[dict]:
    """Boxes round up to ``BOXES`` groups of queries that lie together, each with the lowest score that still helps one of them."""
    tree = Tree(np.arange(len(queries)), queries, max(1, -(-len(queries) // BOXES)))
    return [{"block_low": tree.low[i].tolist(), "block_high": tree.high[i].tolist(), "weakest": float(least[tree.ids[a:b]].min())}
            for i, (a, b) in enumerate(zip(tree.start, tree.end, strict=True)) if i >= tree.first_leaf and b > a]


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """Each row (a tree and a block of queries) with what the block finds there and the k-th scores it now has."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                width = max(r["width"], r["query_width"])
                tree = Tree.__new__(Tree)
                tree.ids, tree.start, tree.end = (np.frombuffer(r[c], np.int64) for c in ("ids", "starts", "ends"))
                tree.rows, tree.low, tree.high = (_wide(np.frombuffer(r[c]).reshape(-1, r["width"]), width) for c in ("points", "low", "high"))
                tree.first_leaf = len(tree.start) // 2
                ids, least = np.frombuffer(r["queries"], np.int64), np.frombuffer(r["least"])
                points = _wide(np.frombuffer(r["query_points"]).reshape(-1, r["query_width"]), width)
                row, names_found, scores = tree.search(ids, points, least, k)
                kth = np.full(len(ids), -np.inf)
                full = np.bincount(row, minlength=len(ids)) == k
                ends = np.cumsum(np.bincount(row, minlength=len(ids))) - 1
                kth[full] = _rounded_down(scores[ends[full]])
                out = [r["block"], r["seed"], r["queries"], r["query_width"], r["query_points"], np.maximum(least, kth).tobytes(),
                       row.astype(np.int64).tobytes(), names_found.tobytes(), scores.tobytes()]
                out.append(_boxes(points, np.maximum(least, kth)))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], names=names)

    schema = f"{_BLOCK}, {_FOUND}, {_REACH}"
    side = pa.list_(pa.float64())
    boxes = pa.list_(pa.struct([("block_low", side), ("block_high", side), ("weakest", pa.float64())]))
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), _REACH.split(" ")[1]: boxes}[c.split(" ")[1]] for c in schema.split(", ")]
    return pairs.mapInArrow(search, schema)


def _meetings(blocks: DataFrame, forest: DataFrame) -> DataFrame:
    """(block, other): the shards whose box allows a score that a query of the block still needs. Only boxes are compared."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = ([np.frombuffer(v.as_py())[:w].tolist() for v, w in zip(batch.column(c), batch.column("width").to_pylist(), strict=True)]
                           for c in ("low", "high"))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), *(pa.array(x, pa.list_(pa.float64())) for x in (lows, highs))],
                                             names=["other", "shard_low", "shard_high"])

    roots = forest.select("shard", "width", "low", "high").mapInArrow(corners, "other int, shard_low array<double>, shard_high array<double>")
    most = F.aggregate(F.arrays_zip("block_low", "block_high", "shard_low", "shard_high"), F.lit(0.0), lambda s, d: s + F.greatest(*[
        F.coalesce(d[b], F.lit(0.0)) * F.coalesce(d[c], F.lit(0.0)) for b in ("block_low", "block_high") for c in ("shard_low", "shard_high")]))
    shards = forest.agg(F.max("shard")).scalar()
    asked = blocks.select("block", "seed", F.inline("boxes")).withColumn("other", F.explode(F.sequence(F.lit(0), shards)))
    return asked.where("other <> seed").join(roots, "other").where(most >= F.col("weakest")).select("block", "other").distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score long): the k rows of ``vectors`` with the highest inner product with each query.

    Both inputs have (vec_id, vector of whole doubles). Rows of the query's own vec_id are no candidates; ties go to the
    smaller vec_id; a query with fewer candidates gets all. Repeated query rows are answered each. Vectors of
    different length count as ending in zeros. Scores are exact; beyond the range of longs they are the nearest long.
    """
    rows = cut_lineage(vectors.select("vec_id", "vector").withColumn("row", F.monotonically_increasing_id()))
    asked = cut_lineage(queries.select("vec_id", "vector").withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    depth = min(MOST_CUTS, max(0, (n - 1) // shard_rows).bit_length())
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).select("vector")
    axes, values = cuts_of(_matrix(sample.toArrow().column("vector").combine_chunks()) if depth else np.zeros((0, 0)), depth)
    cells, shard_of = parted(with_cell(rows, axes, values), "cell", shard_rows, "shard")
    forest = cut_lineage(trees(cells.select("shard", "vec_id", "vector")))
    # Blocks take as many neighbouring cells together as fill them.
    joined = max(0, depth - max(1, asked.count() // block_queries).bit_length() + 1)
    dealt, _ = parted(with_cell(asked, axes, values), f"shiftright(cell, {joined})", block_queries, "block")
    with_rows = np.array(sorted(shard_of), np.int64)
    if not len(with_rows):  # no candidate at all
        return rows.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0L AS score")
    nearby = with_rows[np.searchsorted(with_rows, np.arange((1 << depth) >> joined) << joined).clip(max=len(with_rows) - 1)]
    seeds = F.array(*[F.lit(shard_of[int(c)]) for c in nearby])
    block = query_blocks(dealt.select("block", F.get(seeds, F.shiftright("cell", joined)).alias("seed"), "vec_id", "vector"))
    first = cut_lineage(searched(forest.join(block, F.expr("shard = seed")), k))
    onward = first.join(_meetings(first, forest), "block").drop("found", "found_ids", "found_scores", "boxes")
    second = searched(forest.join(onward, F.expr("shard = other")), k)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row, names, scores = (np.frombuffer(r[c], np.int64) for c in ("found", "found_ids", "found_scores"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), r["block"]), pa.int32()), pa.array(row), pa.array(np.frombuffer(r["queries"], np.int64)[row]),
                     pa.array(names), pa.array(scores)], names=["block", "row", "query_id", "vec_id", "score"])

    parts = ["block", "queries", "found", "found_ids", "found_scores"]
    found = first.select(*parts).unionByName(second.select(*parts)).mapInArrow(
        unpack, "block int, row bigint, query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The top k of every row whose vec_id is divisible by ``every``, among all rows."""
    rows = integer_vectors(vectors)
    return nearest(rows, rows.where(F.col("vec_id") % every == 0), k)
