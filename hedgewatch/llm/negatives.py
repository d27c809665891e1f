"""Hard-negative mining by a vertical scan of columnar blocks.

Rows are sorted by label and by cells of space, and cut into blocks of bounded size; a block holds its vectors by column with each
column's least and greatest value. An anchor reads a block's columns in the order of its own magnitudes, greatest first. What the
columns not yet read can still add lies between sums of those extremes, so after some columns the bitmap of candidates loses all
that cannot reach what the anchor still needs; the rest is read to the end and has exact scores.

An anchor needs its best rows of its own label first (positives). These set windows of scores, and rows of other labels are needed
only inside a window, and only above what the window has already found. Which blocks an anchor meets at all is decided on the blocks'
boxes alone: a first wave goes to the most promising block, and only blocks that can still add something are sent to later ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch.llm.common import quoted
from hedgewatch.session import cut_lineage

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these shares (percent) of the positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Vectors of a block, anchors of a group, boxes that a group meets in one row: bounds on a task's memory.
BLOCK_ROWS, GROUP_ANCHORS, PAGE_BOXES = 2048, 256, 2048
#: Columns read between two looks at the bitmap; a bitmap under this many rows is read to the end at once.
COLUMNS_AT_ONCE, FEW = 8, 64
#: Vectors that the cells of space are fitted on (a bounded sample by hash), and the depth of their halving.
FITTED, DEPTH = 4096, 6
LARGEST = 1e300
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_EXACT = float(1 << 53)


def usable_rows(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector): components floor(scale * x) as doubles. Rows without id, label, or vector, and vectors that are empty
    or hold null or non-finite components, are left out. Components end at ``LARGEST``."""
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).cast("long").alias("label"), F.transform(
        quoted(vector_col), lambda x: x.cast("double")).alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0")
    usable = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return usable.select("vec_id", "label", F.transform("x", lambda v: F.when(F.abs(v * scale) < float(1 << 52), F.floor(v * scale).cast("double")).otherwise(
        F.greatest(F.least(v * scale, F.lit(LARGEST)), F.lit(-LARGEST)))).alias("vector"))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(-1, width)
    rows = np.zeros((len(lengths), width))
    rows[np.arange(width)[None, :] < lengths[:, None]] = flat
    return rows


def halvings(rows: DataFrame, width: int) -> list[tuple[int, float]]:
    """Cells of space: for each node of a binary tree, the widest column of the sample's part there and its median."""
    share = f"CAST(pmod(xxhash64(vec_id, 7), greatest(1, CAST({rows.count()} / {FITTED} AS BIGINT))) AS BIGINT) = 0"
    sample = rows.where(share).orderBy(F.xxhash64("vec_id")).limit(FITTED).select("vector").toArrow()["vector"].combine_chunks()
    points = _matrix(sample, width) if len(sample) else np.zeros((0, width))
    parts, out = [points], []
    for node in range((1 << DEPTH) - 1):
        own = parts[node]
        column = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
        middle = float(np.median(own[:, column])) if len(own) else 0.0
        out.append((column, middle))
        parts += [own[own[:, column] < middle], own[own[:, column] >= middle]]
    return out


def with_cells(rows: DataFrame, cells: list[tuple[int, float]], width: int) -> DataFrame:
    columns, middles = np.array([c for c, _ in cells]), np.array([m for _, m in cells])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"), width)
            node = np.zeros(len(points), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (points[np.arange(len(points)), columns[node]] >= middles[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(walk, "vec_id bigint, label bigint, vector array<double>, cell int")


_BLOCK = "block bigint, ids binary, labels binary, columns binary, low binary, high binary"
_TYPES = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}  # of a schema's columns


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    fields = [c.split(" ") for c in schema.split(", ")]
    values = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in own], _TYPES[kind])
                                       for own, (_, kind) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def blocks(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(vec_id, label, vector, cell) as blocks of at most ``most`` rows that lie together by label and cell.

    Ranges of (label, cell, id) deal the rows out, so a label of any share is many ranges; a partition is cut as it is read, so no block is
    gathered by key.
    """
    parts = max(1, -(-rows.count() // most))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            own = _matrix(table["vector"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())), width)
            return _batch(_BLOCK, (number, table["vec_id"].to_numpy(), table["label"].to_numpy(), np.ascontiguousarray(own.T), own.min(axis=0), own.max(axis=0)))

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                taken = batch.slice(begin, most - size)
                held.append(taken)
                size, begin = size + taken.num_rows, begin + taken.num_rows
                if size == most:
                    yield flushed()
                    held, size, number = [], 0, number + 1
        if size:
            yield flushed()

    order = ["label", "cell", "vec_id"]
    # As many tasks as blocks, also where a session splits ranges further.
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts).mapInArrow(cut, _BLOCK)


class Block:
    """A block's arrays; ``columns`` has one row for each dimension."""

    def __init__(self, row: dict, width: int):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.columns = np.frombuffer(row["columns"]).reshape(width, -1)
        self.low, self.high = np.frombuffer(row["low"]), np.frombuffer(row["high"])
        # Sums of doubles are exact below 2^53; blocks beyond that are scored with whole numbers of any size.
        self.largest = float(np.abs(self.columns).max(initial=0))


def scan(block: Block, anchor: np.ndarray, candidates: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of all candidates (places) whose score is at least ``least`` and at most ``most``, and possibly others.

    Columns are read in the order of the anchor's magnitudes.
    """
    if np.abs(anchor).sum() * block.largest >= _EXACT:
        return candidates, _long_products(anchor, block.columns[:, candidates])
    order = np.argsort(-np.abs(anchor), kind="stable")
    one, other = anchor * block.low, anchor * block.high
    # What the columns from some place in the order on can add: at least, at most.
    less = np.append(np.cumsum(np.minimum(one, other)[order][::-1])[::-1], 0)
    more = np.append(np.cumsum(np.maximum(one, other)[order][::-1])[::-1], 0)
    partial, whole = np.zeros(len(candidates)), len(candidates) == block.columns.shape[1]
    for begin in range(0, len(order), COLUMNS_AT_ONCE):
        end = len(order) if len(candidates) <= FEW else min(len(order), begin + COLUMNS_AT_ONCE)
        own = order[begin:end]
        partial += anchor[own] @ (block.columns[own] if whole else block.columns[own[:, None], candidates])
        # A candidate stays if what it can become meets what is asked for.
        kept = (partial >= least - more[end]) & (partial <= most - less[end])
        if not kept.all():
            candidates, partial, whole = candidates[kept], partial[kept], False
        if end == len(order) or not len(candidates):
            break
    return candidates, partial.astype(np.int64)


def _long_products(anchor: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products with whole numbers; beyond the range of longs the nearest long."""
    own = [int(v) for v in anchor]
    return np.array([max(_LEAST + 1, min(_MOST, sum(a * int(b) for a, b in zip(own, c, strict=True)))) for c in columns.T], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


# A group of anchors, with their windows in the order of anchors: owner, least and greatest score, lowest that is still of use (longs).
_GROUP = "group bigint, anchors binary, anchor_labels binary, points binary, owner binary, least binary, most binary, need binary"


def box_bounds(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each point can have with anything in each box, moved outward by more than sums of doubles are off."""
    up, down = np.maximum(points, 0), np.minimum(points, 0)
    with np.errstate(all="ignore"):
        under, over = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        under, over = under - np.abs(under) * 1e-9 - 1e-6, over + np.abs(over) * 1e-9 + 1e-6
    return np.where(np.isnan(under), -np.inf, under), np.where(np.isnan(over), np.inf, over)


def _outward(values: np.ndarray, sign: int) -> np.ndarray:
    """Longs as doubles; beyond 2^53, where these are rounded, moved outward."""
    rounded = values.astype(float)
    return np.where(np.abs(rounded) < _EXACT, rounded, rounded + sign * np.abs(rounded) * 1e-9)


def meetings(groups: DataFrame, pages: Pages, width: int, same: bool, most: int | None) -> DataFrame:
    """(group, block, worth): blocks in which a group's windows can still find something, decided on boxes and labels alone.

    With ``most``, that many of a page's blocks, those with the highest bounds. Labels lie between a block's least and greatest; a block
    of the anchor's label only has no negatives. A group meets every page of boxes, not every block.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                points = np.frombuffer(r["points"]).reshape(-1, width)
                owner = np.frombuffer(r["owner"], np.int64)
                least, greatest, need = (np.frombuffer(r[c], np.int64) for c in ("least", "most", "need"))
                least, greatest = _outward(np.maximum(least, need), -1), _outward(greatest, 1)
                labels = np.frombuffer(r["anchor_labels"], np.int64)
                low, high = (np.frombuffer(r[c]).reshape(-1, width) for c in ("lows", "highs"))
                first, last = np.frombuffer(r["first_labels"], np.int64), np.frombuffer(r["last_labels"], np.int64)
                numbers = np.frombuffer(r["numbers"], np.int64)
                under, over = box_bounds(points, low, high)
                fits = (first <= labels[:, None]) & (labels[:, None] <= last) if same else ~((first == labels[:, None]) & (last == labels[:, None]))
                can = fits[owner] & (over[owner] >= least[:, None]) & (under[owner] <= greatest[:, None])
                worth = np.where(can, over[owner], -np.inf).max(axis=0, initial=-np.inf)
                chosen = np.flatnonzero(worth > -np.inf)
                if most is not None:
                    chosen = chosen[np.argsort(-worth[chosen], kind="stable")[:most]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), r["group"])), pa.array(numbers[chosen]), pa.array(worth[chosen])],
                                                 names=["group", "block", "worth"])

    each = groups.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages.last))))
    return each.join(pages.rows, "page").drop("page").mapInArrow(decide, "group bigint, block bigint, worth double")


@dataclass
class Pages:
    """Boxes and label ranges of blocks, many in a row; pages are numbered from 0 to ``last``, some may have no rows."""

    rows: DataFrame
    last: int


def box_pages(stored: DataFrame, width: int) -> Pages:
    """Pages of about ``PAGE_BOXES`` blocks."""
    schema = "page int, numbers binary, lows binary, highs binary, first_labels binary, last_labels binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, PAGE_BOXES):
                own = batch.slice(begin, PAGE_BOXES).to_pydict()
                yield _batch(schema, (page, np.array(own["block"], np.int64), np.frombuffer(b"".join(own["low"])), np.frombuffer(b"".join(own["high"])),
                                      np.array(own["first"], np.int64), np.array(own["last"], np.int64)))

    boxes = stored.select("block", "low", "high", "first", "last")
    count = max(1, -(-boxes.count() // PAGE_BOXES))
    return Pages(cut_lineage(boxes.repartition(count).mapInArrow(gather, schema)), count - 1)


_FOUND = "group bigint, window int, anchor int, vec_id bigint, score bigint"


def found_in(pairs: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """Each group's best k rows for each of its windows in each block that it meets: (group, window, anchor, vec_id, score)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                block = Block(r, width)
                anchors, labels = (np.frombuffer(r[c], np.int64) for c in ("anchors", "anchor_labels"))
                points, owner = np.frombuffer(r["points"]).reshape(-1, width), np.frombuffer(r["owner"], np.int64)
                least, most, need = (np.frombuffer(r[c], np.int64) for c in ("least", "most", "need"))
                least = np.maximum(least, need)
                first = np.searchsorted(owner, np.arange(len(anchors) + 1))
                found = []
                for a in range(len(anchors)):
                    open_ = np.arange(first[a], first[a + 1])
                    open_ = open_[least[open_] <= most[open_]]
                    fits = (block.labels == labels[a]) == same
                    if same:
                        fits &= block.ids != anchors[a]
                    candidates = np.flatnonzero(fits)
                    if not len(open_) or not len(candidates):
                        continue
                    # One scan for all windows of an anchor: they lie close together.
                    places, scores = scan(block, points[a], candidates, _outward(least[open_], -1).min(), _outward(most[open_], 1).max())
                    for w in open_.tolist():
                        inside = np.flatnonzero((scores >= least[w]) & (scores <= most[w]))
                        best = inside[_best(block.ids[places[inside]], scores[inside], k)]
                        found += zip([w] * len(best), [a] * len(best), block.ids[places[best]].tolist(), scores[best].tolist(), strict=True)
                window, anchor, ids, scores = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([r["group"]] * len(found), pa.int64()), pa.array(window, pa.int32()), pa.array(anchor, pa.int32()),
                                                  pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["group", "window", "anchor", "vec_id", "score"])

    return pairs.mapInArrow(search, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("group", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(groups: DataFrame, stored: DataFrame, pages: Pages, width: int, same: bool, k: int) -> DataFrame:
    """(group, window, anchor, vec_id, score, rank): the best k rows of every window, exact. Two waves: the most promising block of each page
    of boxes, then all blocks in which the windows can still find something above what they have."""
    bodies = stored.select("block", "ids", "labels", "columns", "low", "high")

    def met(own: DataFrame, chosen: DataFrame) -> DataFrame:
        return found_in(chosen.select("group", "block").join(own, "group").join(bodies, "block"), width, same, k)

    seeds = cut_lineage(meetings(groups, pages, width, same, 1))
    first = cut_lineage(_ranked(met(groups, seeds), k))
    # The k-th score of a window, where it has k rows, is what others must reach.
    kth = first.where(F.col("rank") == k).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    raised = cut_lineage(_with_need(groups.join(kth, "group", "left")))
    rest = meetings(raised, pages, width, same, None).join(seeds, ["group", "block"], "left_anti")
    return cut_lineage(_ranked(first.drop("rank").unionByName(met(raised, cut_lineage(rest))), k))


def _with_need(joined: DataFrame) -> DataFrame:
    names = [c.split(" ")[0] for c in _GROUP.split(", ")]

    def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for need, reached in zip(batch.column("need").to_pylist(), batch.column("reached").to_pylist(), strict=True):
                need = np.frombuffer(need, np.int64).copy()
                for window, score in reached or ():
                    need[window] = max(need[window], score)
                out.append(need.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(n) if n != "need" else pa.array(out, pa.binary()) for n in names], names=names)

    return joined.select(*names, "reached").mapInArrow(raise_, _GROUP)


def anchor_groups(stored: DataFrame, width: int) -> DataFrame:
    """Groups of anchors, from blocks of them, each with one window that takes any score."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                count = len(r["ids"]) // 8
                points = np.ascontiguousarray(np.frombuffer(r["columns"]).reshape(width, -1).T)
                least, most = np.full(count, _LEAST), np.full(count, _MOST)
                yield _batch(_GROUP, (r["block"], r["ids"], r["labels"], points, np.arange(count), least, most, least))

    return stored.select("block", "ids", "labels", "columns").mapInArrow(open_, _GROUP)


def window_groups(groups: DataFrame, positives: DataFrame, least: int, most: int) -> DataFrame:
    """The same groups with a window for each positive, in the order of anchor and rank, and the positives that they belong to.

    A window holds the whole scores n with least * p <= 100 * n <= most * p. Anchors without positives have none.
    """
    listed = positives.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("anchor", "rank", "vec_id", "score"))).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                scores = [f["score"] for f in r["found"]]
                low = [-(-least * s // 100) for s in scores]
                high = [most * s // 100 for s in scores]
                own = _batch(_GROUP, (r["group"], r["anchors"], r["anchor_labels"], r["points"], np.array([f["anchor"] for f in r["found"]], np.int64),
                                      np.array(low, np.int64), np.array(high, np.int64), np.full(len(scores), _LEAST)))
                ids = pa.array([[{"positive_id": f["vec_id"], "positive_score": f["score"]} for f in r["found"]]], _POSITIVES)
                yield pa.RecordBatch.from_arrays([*own.columns, ids], names=[*own.schema.names, "positives"])

    return groups.join(listed, "group").mapInArrow(cut, f"{_GROUP}, positives array<struct<positive_id: bigint, positive_score: bigint>>")


_POSITIVES = pa.list_(pa.struct([("positive_id", pa.int64()), ("positive_score", pa.int64())]))


def mine(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT,
         block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vector of whole doubles).

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are its best rows of the same label (not of its own
    vec_id), its negatives for each the best rows of other labels whose score lies between ``least`` and ``most`` percent of the positive's; ties by
    smaller vec_id; fewer where there are fewer. Repeated rows take part each, repeated anchors are answered each. Vectors of different length
    end in zeros. Scores are exact; beyond the longs they are the nearest long. An empty table, or one without anchors, gives no rows.
    """
    rows = cut_lineage(vectors.select("vec_id", "label", "vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return rows.sparkSession.createDataFrame([], _RESULT)
    placed = cut_lineage(with_cells(rows, halvings(rows, width), width))

    def ends(blocks_: DataFrame) -> DataFrame:
        return cut_lineage(blocks_.mapInArrow(_with_label_range, f"{_BLOCK}, first bigint, last bigint"))

    stored = ends(blocks(placed, width, block_rows))
    pages = box_pages(stored, width)
    asked = placed.where(F.col("vec_id") % every == 0)
    groups = cut_lineage(anchor_groups(blocks(asked, width, group_anchors), width))
    good = search(groups, stored, pages, width, True, positives)
    windows = cut_lineage(window_groups(groups, good, least, most))
    bad = search(windows.drop("positives"), stored, pages, width, False, negatives)
    names = windows.select("group", F.posexplode("positives").alias("window", "p")).select("group", "window", "p.positive_id", "p.positive_score")
    anchors = groups.mapInArrow(_anchor_ids, "group bigint, anchor int, anchor_id bigint")
    return bad.join(names, ["group", "window"]).join(anchors, ["group", "anchor"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _with_label_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = [np.frombuffer(b, np.int64) for b in batch.column("labels").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(v.min()) for v in labels], pa.int64()), pa.array([int(v.max()) for v in labels], pa.int64())],
                                         names=[*batch.schema.names, "first", "last"])


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.select(["group", "anchors"]).to_pylist():
            ids = np.frombuffer(r["anchors"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["group"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                                             names=["group", "anchor", "anchor_id"])
