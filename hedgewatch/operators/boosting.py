"""Gradient-boosted trees over sparse rows: the learner of Spark's ``GBTClassifier``, without its dense copy of the features.

Spark keeps one integer per row and feature. Here a row keeps one short integer per feature that it has, beyond the feature's
lowest bin, and a level of a tree adds up sums over those only. Rows are kept by the block, and within a block by feature and bin. Bins
that hold the same rows of a block, as those of n-grams of one word often do, share one list of them and are added up once.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.session import cut_lineage

#: Bins of a feature, and rows that its thresholds are found from, as Spark has them; all rows are binned and counted.
MAX_BINS, THRESHOLD_ROWS = 32, 10_000
#: Rows and entries of a block, sums that a task holds at once, numbers of a dense part of rows, rounds after which margins are written.
BLOCK_ROWS, BLOCK_ENTRIES, SUMS, DENSE, WRITE_MARGINS = 10_000, 2_000_000, 16_000_000, 8_000_000, 20
EPSILON = 2.0 ** -52

_BLOCK = "part int, cells binary, lists binary, ends binary, rows binary, label binary, weight binary, margin binary"
_BEST = "chunk int, node int, at int, gain double, weight double, total double, right_weight double, right_total double"
_PART, _SUMS = "chunk int, part int, nodes binary, met binary, sums binary", f"{_BEST}, met binary, sums binary"


def _at_thresholds(values: np.ndarray, weights: np.ndarray, sample_weight: float, rows: int) -> list[float]:
    """Thresholds of one feature from the values that it has in the sample (ascending, different) and their weights; the rest is zero."""
    rest = sample_weight - weights.sum()
    if rest > EPSILON * rows * 100:
        at = int(np.searchsorted(values, 0.0))
        values, weights = np.insert(values, at, 0.0), np.insert(weights, at, rest)
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) < MAX_BINS:
        return middle.tolist()
    stride, upto, found = sample_weight / MAX_BINS, np.cumsum(weights), []
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(middle[i - 1])
            target += stride
    return found


Vectors = Callable[[Iterator[pa.Array]], Iterator[pa.Array]]


def _with_vectors(batches: Iterator[pa.RecordBatch], vectors: Vectors) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """Batches with the indices and values of their rows' vectors."""
    here, there = itertools.tee(batches)
    for batch, found in zip(here, vectors(b.column("given") for b in there)):
        yield batch, found.field("indices"), found.field("values")


def _thresholds(rows: DataFrame, vectors: Vectors, features: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """All thresholds, by feature, where those of each feature begin, and the least weight of a row."""
    n, weight, lightest = rows.agg(F.count("*"), F.sum("weight"), F.min("weight")).first()
    share = min(1.0, max(MAX_BINS ** 2, THRESHOLD_ROWS) / n)
    sample = rows if share == 1.0 else rows.sample(False, share, seed)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, indices, values in _with_vectors(batches, vectors):
            yield pa.RecordBatch.from_arrays([batch.column("weight"), indices, values], names=["weight", "indices", "values"])

    entries = sample.select("weight", "given").mapInArrow(opened, "weight double, indices array<int>, values array<double>").select("weight", F.inline(F.arrays_zip("indices", "values")).alias("feature", "value")).where("value <> 0")
    listed = entries.groupBy("feature", "value").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("v"), F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column("v"), batch.column("n").to_pylist()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            values, weights = (lists.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("value", "weight"))
            found = [_at_thresholds(values[a:b], weights[a:b], share * weight, count) for a, b, count in zip(np.append(0, ends), ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(found, pa.list_(pa.float64()))], names=["feature", "found"])

    # at most 31 numbers a feature
    told = listed.select("feature", "v", "n").mapInArrow(run, "feature int, found array<double>").toArrow().sort_by("feature")
    lists = told.column("found").combine_chunks()
    sizes = np.zeros(features, np.int64)
    sizes[told.column("feature").to_numpy()] = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)), lightest


def _blocks(rows: DataFrame, vectors: Vectors, thresholds: np.ndarray, begins: np.ndarray) -> DataFrame:
    """Rows, many in one. An entry is a cell: the place of the largest threshold below its value, among all thresholds; so a row goes
    right at threshold t of a feature if it has a cell from t to the feature's last. Other entries are as good as zeros. A block has its
    different cells in order, the number of each one's list of rows, and the lists: where each ends, and the rows of all."""
    spark = rows.sparkSession
    told = spark.sparkContext.broadcast((thresholds, begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, (thresholds, begins) = TaskContext.get().partitionId(), told.value
        # MAX_BINS places for each feature that has thresholds, the last ones beyond all values
        sizes = np.diff(begins)
        line = np.cumsum(sizes > 0) - 1
        feature = np.repeat(np.arange(len(sizes)), sizes)
        padded = np.full((int((sizes > 0).sum()), MAX_BINS), np.inf)
        padded[line[feature], np.arange(len(feature)) - begins[feature]] = thresholds
        padded = padded.reshape(-1)
        for batch, indices, values in _with_vectors(batches, vectors):
            all_lengths = indices.value_lengths().to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(all_lengths))
            all_features, all_values = (v.flatten().to_numpy(zero_copy_only=False) for v in (indices, values))
            start = 0
            while start < batch.num_rows:
                fitting = int(np.searchsorted(upto, upto[start] + BLOCK_ENTRIES, side="right")) - 1 - start
                some = batch.slice(start, min(BLOCK_ROWS, max(1, fitting)))
                lengths, own = all_lengths[start:start + some.num_rows], slice(upto[start], upto[start + some.num_rows])
                start += some.num_rows
                feature, value = all_features[own], all_values[own]
                row = np.repeat(np.arange(len(lengths)), lengths)
                told_apart = np.flatnonzero(sizes[feature])
                feature, value, row = feature[told_apart], value[told_apart], row[told_apart]
                begin = line[feature] * MAX_BINS
                at, step = begin.copy(), MAX_BINS // 2
                while step:  # bisection, all entries together: how many thresholds are below the value
                    at += step * (padded[at + (step - 1)] < value)
                    step //= 2
                kept = at > begin
                cells, row = (begins[feature] + (at - begin - 1))[kept], row[kept]
                # by cell, then row
                keys = np.sort((cells << 16) | row)
                cells, own = keys >> 16, (keys & 0xFFFF).astype(np.uint16)
                first = np.flatnonzero(np.diff(cells, prepend=-1))
                sign = 2.0 * some.column("label").to_numpy(zero_copy_only=False) - 1.0
                weight = some.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
                yield _block(part, cells[first].astype(np.int32), *_shared(own, first), sign, weight, np.zeros(len(sign)))

    # as many tasks as there are cores: each gives its sums of a level once, whatever the rows
    return cut_lineage(rows.coalesce(spark.sparkContext.defaultParallelism).select("given", "label", "weight").mapInArrow(run, _BLOCK))


def _shared(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of rows, one after the other, to different ones: the number of each list, where each different one ends, and their rows."""
    sizes = np.diff(first, append=len(rows))
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), rows
    drawn = np.random.default_rng(0).integers(0, 1 << 62, int(rows.max()) + 1)
    _, one, number = np.unique(np.add.reduceat(drawn[rows], first), return_index=True, return_inverse=True)
    # sums of drawn numbers suggest which are equal, a comparison row by row tells
    alike = np.array_equal(sizes[one][number], sizes) and np.array_equal(rows[np.arange(len(rows)) + np.repeat(first[one][number] - first, sizes)], rows)
    if not alike:
        one = number = np.arange(len(first))
    ends = np.cumsum(sizes[one])
    return number.astype(np.int32), ends.astype(np.int32), rows[np.arange(ends[-1]) + np.repeat(first[one] - ends + sizes[one], sizes[one])]


def _block(part: int, *columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=names)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["part"], *[np.frombuffer(row[c], np.int32) for c in ("cells", "lists", "ends")], np.frombuffer(row["rows"], np.uint16),
                   *[np.frombuffer(row[c], np.float64) for c in ("label", "weight", "margin")])


# --- trees --------------------------------------------------------------------

# A tree is lists by node: feature, threshold (larger values go right), value, left (its left child, the right one is next; 0: a leaf). In
# training the threshold is a place among all thresholds.


class _Walk:
    """Rows down some trees. ``column`` numbers the features that the trees ask for."""

    def __init__(self, trees: list[dict]):
        self.trees = [{k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in t.items()} for t in trees]
        self.asked = np.unique(np.concatenate([t["feature"][t["left"] > 0] for t in self.trees] + [np.zeros(0, np.int64)]))
        self.columns = [np.searchsorted(self.asked, t["feature"]) for t in self.trees]

    def leaf(self, tree: int, held: np.ndarray) -> np.ndarray:
        """The nodes that rows end in; ``held`` has their values of the asked features."""
        t, column = self.trees[tree], self.columns[tree]
        at, rows = np.zeros(len(held), np.int64), np.arange(len(held))
        while (inner := t["left"][at] > 0).any():
            right = held[rows, np.where(inner, column[at], 0)] > t["threshold"][at]
            at = np.where(inner, t["left"][at] + right, at)
        return at

    def margin(self, held: np.ndarray, factors: list[float], start: np.ndarray) -> np.ndarray:
        total = start.copy()
        for tree, factor in enumerate(factors):
            total += factor * self.trees[tree]["value"][self.leaf(tree, held)]
        return total


class _Down:
    """The rows of blocks down trees in training."""

    def __init__(self, trees: list[dict], begins: np.ndarray):
        self.trees = []
        for tree in trees:
            feature, left = np.array(tree["feature"], np.int64), np.array(tree["left"], np.int64)
            first, last = np.ceil(np.array(tree["threshold"])).astype(np.int64), begins[feature + 1]
            levels, nodes = [], [0]
            while nodes := [n for n in nodes if left[n]]:
                levels.append(nodes)
                nodes = [child for n in nodes for child in (int(left[n]), int(left[n]) + 1)]
            # without a cell that leads to the right, a row goes left
            self.trees.append((levels, np.stack([first, last]), left, np.where(left > 0, left, np.arange(len(left))), np.array(tree["value"])))

    def leaf(self, tree: int, cells: np.ndarray, lists: np.ndarray, ends: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
        """The nodes that a block's rows end in."""
        levels, bounds, left, other, _ = self.trees[tree]
        at = np.zeros(rows, np.int64)
        (first, last), whole = np.searchsorted(cells, bounds), np.append(0, ends)
        for nodes in levels:
            next_ = other[at]
            for node in nodes:
                for n in lists[first[node]:last[node]].tolist():
                    right = own[whole[n]:whole[n + 1]]
                    next_[right[at[right] == node]] = left[node] + 1
            at = next_
        return at

    def margin(self, trees: int, factors: list[float], start: np.ndarray, *block: np.ndarray) -> np.ndarray:
        total = start.copy()
        for tree, factor in zip(range(trees), factors):
            total += factor * self.trees[tree][4][self.leaf(tree, *block, len(start))]
        return total


def _add_up(by_cell: np.ndarray, cell: np.ndarray, lists: np.ndarray, ends: np.ndarray, row: np.ndarray, slot: np.ndarray, what: np.ndarray) -> None:
    """Add a block's ``what``, by row, to ``by_cell``, by cell and the row's slot; rows of slot -1 are left out."""
    slots, whole = slot[row], np.append(0, ends)
    kept = np.flatnonzero(slots >= 0)
    if not len(kept):
        return
    if by_cell.shape[1] == 1 and len(kept) == len(row):
        by_cell[cell, 0] += np.add.reduceat(what[row], whole[:-1])[lists]
        return
    place = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(whole))
    slots, row, place = slots[kept], row[kept], place[kept]
    if by_cell.shape[1] > 1:  # by slot, then list
        order = np.argsort(slots, kind="stable")
        slots, row, place = slots[order], row[order], place[order]
    starts = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(slots, prepend=-1) != 0))
    of_list, met = np.zeros((len(ends), by_cell.shape[1]), np.complex128), np.zeros(len(ends), bool)
    of_list[place[starts], slots[starts]] = np.add.reduceat(what[row], starts)
    met[place[starts]] = True
    own = np.flatnonzero(met[lists])
    by_cell[cell[own]] += of_list[lists[own]]


def _best(blocks: DataFrame, told: Broadcast, trees: list[dict], factors: list[float], tree: dict, built: list[int],
          siblings: dict[int, tuple[int, int]], known: DataFrame | None, lightest: float, first: bool) -> tuple[dict[int, dict], DataFrame]:
    """For some nodes of a tree's deepest level their sums and best split: the one that explains most variance, the first of equals.
    Also the sums by cell, a row for each chunk and node.

    A task adds up weights and weighted residuals by (node, cell) for the ``built`` nodes, a chunk of features at a time they are added
    up over tasks. ``siblings`` names for each other node its built sibling and their parent: its sums are the parent's, which are
    ``known``, less the sibling's, so that rows of the larger child cost nothing."""
    begins = told.value
    cells, chunks, nodes = int(begins[-1]), 2 * blocks.sparkSession.sparkContext.defaultParallelism, [*built, *siblings]
    # chunks end where a feature ends
    cuts = np.unique(begins[np.searchsorted(begins, np.linspace(0, cells, chunks + 1).astype(np.int64))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down, part = _Down([*trees, tree], told.value), None
        slot_of = np.full(len(tree["value"]), -1, np.int16)
        slot_of[nodes] = np.arange(len(nodes))
        by_cell, by_node = np.zeros((cells, len(built)), np.complex128), np.zeros((3, len(nodes)))
        for part, cell, lists, ends, row, sign, weight, margin in _opened(batches):
            block = cell, lists, ends, row
            slot = slot_of[down.leaf(len(trees), *block, len(sign))]
            if first:
                residual = sign
            else:
                residual = 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * down.margin(len(trees), factors, margin, *block), 700.0)))
            own = slot >= 0
            moved = weight * residual
            for to, what in zip(by_node, (weight, moved, moved * residual)):
                to += np.bincount(slot[own], what[own], minlength=len(nodes))
            # both sums at once, as the parts of a number
            _add_up(by_cell, *block, np.where(slot < len(built), slot, np.int16(-1)), weight + 1j * moved)
        if part is None:
            return
        for chunk, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = by_cell[a:b].reshape(-1)
            met = np.flatnonzero(own.real)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in (
                    by_node, met.astype(np.int32), own[met])]], names=["chunk", "part", "nodes", "met", "sums"])

    def best(table: pa.Table, parents: pa.Table | None = None) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        a, b = cuts[chunk], cuts[chunk + 1]
        by_node, by_cell = np.zeros((3, len(nodes))), np.zeros((len(nodes), b - a), np.complex128)
        added = np.zeros((b - a) * len(built), np.complex128)
        # in the order of parts, so that a repeated job adds up alike
        for i in np.argsort(table.column("part").to_numpy()).tolist():
            by_node += np.frombuffer(table.column("nodes")[i].as_py()).reshape(by_node.shape)
            added[np.frombuffer(table.column("met")[i].as_py(), np.int32)] += np.frombuffer(table.column("sums")[i].as_py(), np.complex128)
        by_cell[:len(built)] = added.reshape(b - a, -1).T
        place_of = {node: i for i, node in enumerate(parents.column("node").to_pylist())} if parents is not None else {}
        for slot, (sibling, parent) in enumerate(siblings.values(), len(built)):
            met, sums_ = (np.frombuffer(parents.column(c)[place_of[parent]].as_py(), t) for c, t in (("met", np.int32), ("sums", np.complex128)))
            by_cell[slot, met] = sums_
            by_cell[slot] -= by_cell[nodes.index(sibling)]
        begins = told.value
        own = np.unique(begins[(begins >= a) & (begins <= b)])
        sizes = np.diff(own)
        feature, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(b - a) - np.repeat(own[:-1] - a, sizes)
        found = []
        for slot, node in enumerate(nodes):
            weight, total, squares = by_node[:, slot]
            right = np.zeros((len(sizes), int(sizes.max())), np.complex128)
            right[feature, place] = by_cell[slot]
            right = np.cumsum(right[:, ::-1], axis=1)[:, ::-1][feature, place]
            right = right.real, right.imag
            left = weight - right[0]
            fits = (right[0] > lightest / 2) & (left > lightest / 2)
            gain = np.full(b - a, -np.inf)
            gain[fits] = right[1][fits] ** 2 / right[0][fits] + (total - right[1][fits]) ** 2 / left[fits] - total ** 2 / weight
            at = int(np.argmax(gain))
            pure = (squares - total ** 2 / weight) / weight < EPSILON
            # what rounding alone can give is no gain
            gained = float(gain[at]) if not pure and gain[at] > 1e-13 * squares else -1.0
            met = np.flatnonzero(by_cell[slot])
            found.append((chunk, node, int(a) + at, gained, weight, total, right[0][at], right[1][at], met.astype(np.int32).tobytes(), by_cell[slot, met].tobytes()))
        kinds = [pa.int32()] * 3 + [pa.float64()] * 5 + [pa.binary()] * 2
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[c.split(" ")[0] for c in _SUMS.split(", ")])

    partial = blocks.mapInArrow(sums, _PART).groupBy("chunk")
    if siblings:
        parents = known.where(F.col("node").isin([parent for _, parent in siblings.values()])).select("chunk", "node", "met", "sums")
        every = partial.cogroup(parents.groupBy("chunk")).applyInArrow(lambda table, parents: best(table, parents), _SUMS)
    else:
        every = partial.applyInArrow(lambda table: best(table), _SUMS)
    every = every.persist()
    found: dict[int, dict] = {}
    # a row for each chunk and node
    for r in sorted(every.select(*[c.split(" ")[0] for c in _BEST.split(", ")]).collect(), key=lambda r: r["chunk"]):
        if r["node"] not in found or r["gain"] > found[r["node"]]["gain"]:
            found[r["node"]] = r.asDict()
    return found, every


def _grow(blocks: DataFrame, told: Broadcast, trees: list[dict], factors: list[float], max_depth: int, lightest: float, first: bool) -> dict:
    """One tree, level by level."""
    begins = told.value
    tree = {"feature": [0], "threshold": [0.0], "value": [0.0], "left": [0]}
    # nodes whose rows are added up, and of each other one its sibling among these and their parent
    built, siblings, at_once, known = [0], {}, max(1, SUMS // int(begins[-1])), []
    for _ in range(max_depth):
        found, parents, known = {}, known, []
        together = functools.reduce(DataFrame.union, parents) if parents else None
        for start in range(0, len(built), at_once):
            some = built[start:start + at_once]
            best, sums = _best(blocks, told, trees, factors, tree, some, {k: v for k, v in siblings.items() if v[0] in some}, together, lightest, first)
            found |= best
            known.append(sums)
        for sums in parents:
            sums.unpersist()
        built, siblings = [], {}
        for node, split in sorted(found.items()):
            tree["value"][node] = split["total"] / split["weight"]
            if not split["gain"] > 0.0:
                continue
            child = len(tree["value"])
            tree["feature"][node] = int(np.searchsorted(begins, split["at"], side="right")) - 1
            tree["threshold"][node], tree["left"][node] = split["at"] - 0.5, child
            right_weight, right_total = split["right_weight"], split["right_total"]
            for name, values in (("feature", [0, 0]), ("threshold", [0.0, 0.0]), ("left", [0, 0]), ("value", [
                    (split["total"] - right_total) / (split["weight"] - right_weight), right_total / right_weight])):
                tree[name] += values
            lighter = child + (2 * right_weight < split["weight"])
            built.append(lighter)
            siblings[2 * child + 1 - lighter] = lighter, node
        if not built:
            break
    for sums in known:
        sums.unpersist()
    return tree


@contextlib.contextmanager
def _one_by_one(spark: SparkSession) -> Iterator[None]:
    """Blocks travel to Python one by one: a batch of many is copied again each time that it outgrows its memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(1 << 20))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _with_margins(blocks: DataFrame, told: Broadcast, trees: list[dict], factors: list[float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down = _Down(trees, told.value)
        for part, cell, lists, ends, row, sign, weight, margin in _opened(batches):
            block = cell, lists, ends, row
            yield _block(part, *block, sign, weight, down.margin(len(trees), factors, margin, *block))

    return cut_lineage(blocks.mapInArrow(run, _BLOCK))


def _leaves(rows: DataFrame, rounds: int, step_size: float) -> list[dict]:
    sums = np.array([tuple(r) for r in rows.groupBy((2.0 * F.col("label") - 1.0).alias("sign")).agg(F.sum("weight")).collect()])
    sign, weight = sums.T
    margin, trees = 0.0, []
    for done in range(rounds):
        residual = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)) if done else sign
        value = float((weight * residual).sum() / weight.sum())
        trees.append({"feature": [0], "threshold": [0.0], "value": [value], "left": [0]})
        margin += value * (step_size if done else 1.0)
    return trees


def fit(rows: DataFrame, features: int, rounds: int, step_size: float, max_depth: int, seed: int,
        given: Column | None = None, vectors: Vectors = lambda batches: batches) -> BoostedTrees:
    """Boosted regression trees for the logistic loss, on ``rows(features, label, weight)``: sparse vectors of numbers that are not
    negative, labels 0 and 1. Steps, splits and leaf values are those of ``GBTClassifier``: the first tree fits the labels as -1 and
    1, each other one the loss's falling slope, at ``step_size``. Rows without ``features`` have something ``given`` that ``vectors``
    makes vectors of: in the step that uses them, so that they are never written."""
    rows = rows.select("label", F.col("weight").cast("double").alias("weight"), (F.unwrap_udt("features") if given is None else given).alias("given"))
    thresholds, begins, lightest = _thresholds(rows, vectors, features, seed)
    if not begins[-1]:  # no feature tells rows apart: a leaf a round
        return BoostedTrees(trees=json.dumps(_leaves(rows, rounds, step_size)), stepSize=step_size)
    blocks, written, trees, told = _blocks(rows, vectors, thresholds, begins), 0, [], rows.sparkSession.sparkContext.broadcast(begins)
    with _one_by_one(rows.sparkSession):
        for done in range(rounds):
            factors = [1.0 if i == 0 else step_size for i in range(done)]
            if done - written == WRITE_MARGINS:
                blocks, written = _with_margins(blocks, told, trees[written:], factors[written:]), done
            trees.append(_grow(blocks, told, trees[written:], factors[written:], max_depth, lightest, done == 0))
    told.destroy()
    for tree in trees:
        tree["threshold"] = [float(thresholds[int(t + 0.5)]) if left else 0.0 for t, left in zip(tree["threshold"], tree["left"])]
    return BoostedTrees(trees=json.dumps(trees), stepSize=step_size)


class BoostedTrees(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees. ``transform`` adds ``rawPrediction``, ``probability`` and ``prediction``, as ``GBTClassificationModel`` does."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON, in order", TypeConverters.toString)
    stepSize = Param(Params._dummy(), "stepSize", "what each tree but the first is multiplied by", TypeConverters.toFloat)
    numClasses = 2

    @keyword_only
    def __init__(self, *, trees: str = "[]", stepSize: float = 0.1):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        walk = _Walk(json.loads(self.getOrDefault(self.trees)))
        factors = [self.getOrDefault(self.stepSize) if i else 1.0 for i in range(len(walk.trees))]

        def margins(features: pa.Array) -> pa.Array:
            lists = features.field("indices")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            feature, value = (features.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
            ends = np.append(0, np.cumsum(lengths))
            at_once, found = max(1, DENSE // max(1, len(walk.asked))), [np.zeros(0)]
            for start in range(0, len(lengths), at_once):
                size = lengths[start:start + at_once]
                a, b = ends[start], ends[start + len(size)]
                held, row = np.zeros((len(size), max(1, len(walk.asked)))), np.repeat(np.arange(len(size)), size)
                if len(walk.asked):
                    column = np.minimum(np.searchsorted(walk.asked, feature[a:b]), len(walk.asked) - 1)
                    met = np.flatnonzero(walk.asked[column] == feature[a:b])
                    held[row[met], column[met]] = value[a:b][met]
                found.append(walk.margin(held, factors, np.zeros(len(size))))
            return pa.array(np.concatenate(found))

        opened = df.withColumn("__v", F.unwrap_udt(self.getFeaturesCol()))
        margin, one = F.col("__margin"), 1.0 / (1.0 + F.exp(-2.0 * F.col("__margin")))
        return opened.withColumn("__margin", F.arrow_udf(margins, T.DoubleType())(F.struct("__v.indices", "__v.values"))).withColumns({
            "rawPrediction": array_to_vector(F.array(-margin, margin)), "probability": array_to_vector(F.array(1.0 - one, one)),
            "prediction": F.when(margin > 0, 1.0).otherwise(0.0)}).drop("__v", "__margin")
