"""Embedding near-duplicates by NN-descent.

Equal vectors are one class. Classes start with the neighbours they meet in a few random-hyperplane orders, and then refine
their lists through neighbours of neighbours: around each node, the nodes that list it and that it lists are compared with
each other. Lists whose entries are all links are saturated: there may be more links than entries, so they are enlarged to the
node's whole component, whose links are counted exactly (and never written out as pairs). A sample is then audited against
all vectors, by node and stratum of true links; too low a recall doubles the lists and adds orders, and where that does not
help, all vectors are compared in blocks.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch.llm.common import components, quoted
from hedgewatch.session import cut_lineage

THRESHOLD, NEIGHBOURS, ORDERS, HYPERPLANES = 0.9, 8, 8, 24
#: Rows that stand next to each other in an order and are compared; nodes compared around a centre in one go.
BLOCK, AROUND = 64, 64
#: Refinement ends after so many rounds, or when fewer than this share of list entries change.
ROUNDS, STILL = 4, 0.002
#: Vectors audited against all others (bounded samples by hash, each larger than the one before), how many with links will do, least recall, and
#: how often lists are doubled for it.
AUDITED, ENOUGH, LEAST_RECALL, DOUBLINGS = (1024, 8192, 65_536), 200, 0.95, 2
#: Links of an audited node that a task passes on.
FEW = 64
#: Nodes of the sample are strata by the power of this base that their true links reach.
STRATUM = 8
#: Vectors of one component compared in one go, or of a block where all are compared.
MEETING = 1024
#: Half-precision vectors find candidates; links this close below the threshold are kept for the check in double precision.
MARGIN = 0.002


def unit_rows(blobs: list[bytes], kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    rows = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return rows / np.sqrt(np.square(rows).sum(axis=1))[:, None]


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, key, raw, half): a digest of each usable vector, its components in double and, scaled to length 1, in half precision.

    Vectors that are null, empty, zero or hold null or non-finite components have null in these columns. Digests of
    vectors of different length differ, and such vectors link with nothing of another length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, halves = [], [], []
            for row in batch.column("x"):
                values = row.values
                fit = values is not None and len(values) and not values.null_count
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if fit else np.zeros(0)
                most = np.abs(x).max(initial=0)
                if not (0 < most < np.inf):
                    keys, raws, halves = [*keys, None], [*raws, None], [*halves, None]
                    continue
                scaled = x / most  # far from overflow whatever the scale
                keys.append(hashlib.md5(x.tobytes()).hexdigest())
                raws.append(scaled.tobytes())
                halves.append((scaled / np.sqrt(np.square(scaled).sum())).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.string()), pa.array(raws, pa.binary()), pa.array(halves, pa.binary())],
                                             names=["vec_id", "key", "raw", "half"])

    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), F.transform(quoted(vector_col), lambda x: x.cast("double")).alias("x"))
    return rows.mapInArrow(read, "vec_id bigint, key string, raw binary, half binary")


def _forest(linked: np.ndarray, unsure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of a symmetric matrix: a spanning forest of ``linked``, and all ``unsure`` ones between its components.

    Whatever of the unsure ones holds in the end, these pairs have the components of all pairs.
    """
    tree = np.full(len(linked), -1)
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in np.flatnonzero(linked.any(axis=1)):
        if tree[start] >= 0:
            continue
        tree[start], stack = start, [start]
        while stack:
            node = stack.pop()
            reached = np.flatnonzero(linked[node] & (tree < 0))
            tree[reached] = start
            rows, columns = [*rows, np.full(len(reached), node)], [*columns, reached]
            stack += reached.tolist()
    tree = np.where(tree < 0, np.arange(len(tree)), tree)
    row, column = np.nonzero(np.triu(unsure, 1))
    apart = tree[row] != tree[column]
    return np.concatenate([*rows, row[apart]]), np.concatenate([*columns, column[apart]])


def _pairs(ids: np.ndarray, scores: np.ndarray, k: int, above: np.ndarray, least: float) -> list[np.ndarray]:
    """Of square ``scores``: each row's k best columns better than ``above``, and links that join whatever is linked.

    Scores of half-precision vectors are within MARGIN: links are sure from two margins above ``least``.
    """
    n = len(ids)
    np.fill_diagonal(scores, -2)
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), (n, n))
    row, column = np.repeat(np.arange(n), top.shape[1]), top.ravel()
    good = scores[row, column] > np.maximum(above[row], -1.5)
    sure = scores >= least + 2 * MARGIN
    from_, to = _forest(sure, (scores >= least) & ~sure)
    row, column, link = (np.concatenate(x) for x in ((row[good], from_), (column[good], to), (np.zeros(good.sum(), bool), np.ones(len(to), bool))))
    return [ids[row], ids[column], scores[row, column].astype(np.float32), link]


_FOUND = "id bigint, other bigint, score float, link boolean"


def _emit(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.float32, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "other", "score", "link"])


def first_neighbours(nodes: DataFrame, k: int, least: float, seed: int) -> DataFrame:
    """Pairs of nodes (id, half) that stand in one block of an order by random hyperplanes, as (id, other, score, link)."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column("half").to_pylist()
            sizes = np.array([len(h) for h in halves])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = unit_rows([halves[i] for i in at], np.float16)
                own = batch.take(pa.array(at))
                for order in range(ORDERS):
                    planes = np.random.default_rng([seed, order, size]).standard_normal((HYPERPLANES, rows.shape[1]))
                    bits = (rows @ planes.T >= 0) @ (1 << np.arange(HYPERPLANES, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), order, np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(bits),
                                                      own.column("id"), own.column("half")], names=["order", "size", "code", "id", "half"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([b for b in (left, batch) if b is not None]).combine_chunks()
            full = table.num_rows // BLOCK * BLOCK
            yield from blocks(table.slice(0, full))
            rest = table.slice(full).combine_chunks().to_batches()
            left = rest[0] if rest else None
        if left is not None:
            yield from blocks(pa.Table.from_batches([left]))

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        halves, found = table.column("half").to_pylist(), []
        for begin in range(0, len(ids), BLOCK):
            for width in np.unique(size[begin:begin + BLOCK]):
                at = begin + np.flatnonzero(size[begin:begin + BLOCK] == width)
                rows = unit_rows([halves[i] for i in at], np.float16).astype(np.float32)
                found.append(_pairs(ids[at], rows @ rows.T, k, np.full(len(at), -2.0), least))
        if found:
            yield _emit(found)

    placed = nodes.select("id", "half").mapInArrow(codes, "order int, size int, code bigint, id bigint, half binary")
    # Every row is told apart by its id, so equal codes never force rows into one task.
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(parts, "order", "size", "code", "id").sortWithinPartitions("order", "size", "code", "id").mapInArrow(meet, _FOUND)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each node's neighbours (id, other, score, fresh): fresh if no earlier list had it."""
    each = pairs.groupBy("id", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return each.withColumn("place", place).where(F.col("place") <= k).drop("place")


def refined(nodes: DataFrame, lists: DataFrame, k: int, least: float) -> DataFrame:
    """One round of neighbours of neighbours, as (id, other, score, link): only what betters a full list, and links."""
    sides = lists.selectExpr("id AS centre", "other AS member", "fresh").unionByName(lists.selectExpr("other AS centre", "id AS member", "fresh"))
    around = sides.groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    # A node that many others list is dealt into parts; one without a fresh pair has nothing new to say.
    parts = around.groupBy("centre").agg(F.max("fresh").alias("any"), F.expr(f"CAST(ceil(count(1) / {AROUND}) AS INT)").alias("parts")).where("any")
    dealt = around.join(parts.drop("any"), "centre").withColumn("part", F.expr("pmod(xxhash64(member, centre), parts)"))
    kth = lists.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).cast("float").alias("kth"))
    members = nodes.select("id", "half").join(kth, "id", "left").select(F.col("id").alias("member"), "half", F.coalesce("kth", F.lit(-2.0).cast("float")).alias("kth"))
    groups = dealt.join(members, "member").groupBy("centre", "part").agg(F.collect_list(F.struct("member", "half", "kth")).alias("own"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            offsets, flat = lists.offsets.to_numpy(), lists.flatten()
            offsets = offsets - offsets[0]
            ids, halves, kth = flat.field("member").to_numpy(), flat.field("half").to_pylist(), flat.field("kth").to_numpy()
            found = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                for width in {len(h) for h in halves[a:b]}:
                    at = np.array([i for i in range(a, b) if len(halves[i]) == width])
                    if len(at) > 1:
                        rows = unit_rows([halves[i] for i in at], np.float16).astype(np.float32)
                        found.append(_pairs(ids[at], rows @ rows.T, k, kth[at], least))
            yield _emit(found)

    return groups.select("own").mapInArrow(meet, _FOUND)


def exact_links(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b) those with a cosine of at least ``threshold`` in double precision."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good = [len(x) == len(y) and float(unit_rows([x])[0] @ unit_rows([y])[0]) >= threshold for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(nodes.selectExpr("id AS a", "raw AS left"), "a").join(nodes.selectExpr("id AS b", "raw AS right"), "b")
    return both.mapInArrow(verify, "a bigint, b bigint")


def links_within(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): how many vectors each node of ``members`` (component, id, copies, raw) links with in its component.

    Nodes within half the threshold's angle of their component's first node (its core) all link with each other, so they
    are only counted. The others meet all nodes of the component in blocks; blocks give a count per node, no pairs.
    """
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    lead = members.where("id = component").selectExpr("component", "raw AS lead")

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = [len(x) == len(y) and float(unit_rows([x])[0] @ unit_rows([y])[0]) >= half
                    for x, y in zip(batch.column("raw").to_pylist(), batch.column("lead").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(core, pa.bool_())], names=[*names, "core"])

    names = ["component", "id", "copies", "raw"]
    told = cut_lineage(members.join(lead, "component").select(*names, "lead").mapInArrow(
        angle, "component bigint, id bigint, copies bigint, raw binary, core boolean"))
    sizes = told.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"),
        F.expr(f"CAST(ceil(count_if(NOT core) / {MEETING}) AS INT)").alias("outer_blocks"), F.expr(f"CAST(ceil(count(1) / {MEETING}) AS INT)").alias("blocks"))
    sized = told.join(sizes, "component")
    alone = sized.selectExpr("id", "IF(core, core_copies, copies) - 1 AS links")
    mixed = sized.where("outer_blocks > 0")
    outer = mixed.where("NOT core").selectExpr("component", "id", "copies", "raw", "core", "true AS asks", "pmod(xxhash64(id), outer_blocks) AS i",
                                               "explode(sequence(0, blocks - 1)) AS j")
    every = mixed.selectExpr("component", "id", "copies", "raw", "core", "false AS asks", "pmod(xxhash64(id, 1), blocks) AS j",
                             "explode(sequence(0, outer_blocks - 1)) AS i")
    groups = outer.selectExpr("component", "i", "CAST(j AS BIGINT) AS j", "id", "copies", "raw", "core", "asks").unionByName(
        every.selectExpr("component", "CAST(i AS BIGINT) AS i", "j", "id", "copies", "raw", "core", "asks")).groupBy("component", "i", "j").agg(
        F.collect_list(F.struct("id", "copies", "raw", "core", "asks")).alias("own"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, links_out = [], []
            for own in batch.column("own"):
                rows = own.as_py()
                asks, others = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
                if not asks or not others:
                    continue
                near = unit_rows([r["raw"] for r in asks]) @ unit_rows([r["raw"] for r in others]).T >= threshold
                ids = [np.array([r["id"] for r in x], np.int64) for x in (asks, others)]
                near[ids[0][:, None] == ids[1][None, :]] = False
                copies = [np.array([r["copies"] for r in x], np.int64) for x in (asks, others)]
                core = np.array([r["core"] for r in others])
                ids_out += [ids[0], ids[1][core]]
                links_out += [near @ copies[1], (copies[0] @ near)[core]]
            if ids_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids_out)), pa.array(np.concatenate(links_out))], names=["id", "links"])

    met = groups.select("own").mapInArrow(meet, "id bigint, links bigint")
    return alone.unionByName(met).groupBy("id").agg(F.sum("links").alias("links"))


class Audit:
    """True links of a bounded sample of nodes, from comparing it with all of them.

    The sample grows until ``ENOUGH`` of its nodes have a link with a different vector, or it holds all nodes or the last of ``AUDITED``:
    where links are rare, a small sample would say nothing. ``links`` are the links it met on nodes with at most ``FEW`` of them in a task, which
    is where a search loses some; ``complete`` tells that all nodes were audited.
    """

    def __init__(self, nodes: DataFrame, threshold: float, sizes: tuple[int, ...] = AUDITED, seed: int = 0):
        count = nodes.count()
        for size in sizes:
            self.sample = nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(size).select("id")
            asked = nodes.join(F.broadcast(self.sample), "id").select("id", "raw", "copies").collect()  # at most ``size`` vectors
            self.copies = {r["id"]: r["copies"] for r in asked}
            met = cut_lineage(_met(nodes, [(r["id"], r["raw"]) for r in asked], threshold))
            # Nodes of the sample with their true links with different vectors: at most ``size`` rows.
            self.true = dict(met.where("b IS NULL").groupBy("a").agg(F.sum("copies")).collect())
            self.complete = size >= count
            if self.complete or len(self.true) >= ENOUGH:
                break
        self.links = met.where("b IS NOT NULL").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()

    def recall(self, counted: DataFrame) -> float:
        """The least recall of the strata of the sample.

        A node counts if it links with a different vector, and counts once: its recall is the share of its links with different vectors that
        was found. Strata are by number of these links, so that neither large groups hide small ones nor the other way round. 1 if no node counts.
        """
        links = {r["id"]: r["links"] for r in counted.join(F.broadcast(self.sample), "id").select("id", "links").collect()}
        strata: dict[int, list[float]] = {}
        for node, true in self.true.items():
            copies = self.copies[node]
            strata.setdefault(int(math.log(true + 0.5, STRATUM)), []).append((links.get(node, copies - 1) - copies + 1) / true)
        return min((sum(shares) / len(shares) for shares in strata.values()), default=1.0)


def recall(nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """The audited recall of what ``counted`` (id, links) says of ``nodes``."""
    return Audit(nodes, threshold).recall(counted)


def _met(nodes: DataFrame, asked: list[tuple[int, bytes]], threshold: float) -> DataFrame:
    """(a, b, copies) of audited nodes a: rows with b are links with it, rows without sum up the copies linked within a task."""
    shared = nodes.sparkSession.sparkContext.broadcast(asked)  # at most the last of AUDITED vectors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {len(r) for _, r in shared.value}:
            own = [(i, r) for i, r in shared.value if len(r) == width]
            by_width[width] = np.array([i for i, _ in own]), unit_rows([r for _, r in own])
        total = {w: np.zeros(len(ids), np.int64) for w, (ids, _) in by_width.items()}
        few = {w: np.zeros(len(ids), np.int64) for w, (ids, _) in by_width.items()}
        for whole in batches:
            for begin in range(0, whole.num_rows, MEETING):
                batch = whole.slice(begin, MEETING)
                raws, own, copies = batch.column("raw").to_pylist(), batch.column("id").to_numpy(), batch.column("copies").to_numpy()
                for width in {len(r) for r in raws} & set(by_width):
                    ids, rows = by_width[width]
                    to = np.array([i for i, r in enumerate(raws) if len(r) == width])
                    others = unit_rows([raws[i] for i in to]).T
                    for first in range(0, len(ids), MEETING):
                        at, other = np.nonzero(rows[first:first + MEETING] @ others >= threshold)
                        at, other = at + first, to[other]
                        different = ids[at] != own[other]
                        at, other = at[different], other[different]
                        if len(at):
                            np.add.at(total[width], at, copies[other])
                            kept = few[width][at] < FEW
                            np.add.at(few[width], at, 1)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[at[kept]]), pa.array(own[other[kept]]), pa.array(copies[other[kept]])], names=["a", "b", "copies"])
        for width, (ids, _) in by_width.items():
            found = np.flatnonzero(total[width])
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.nulls(len(found), pa.int64()), pa.array(total[width][found])], names=["a", "b", "copies"])

    return nodes.select("id", "raw", "copies").mapInArrow(count, "a bigint, b bigint, copies bigint")


def all_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of all pairs of ``nodes`` (id, raw) of at least ``threshold``: every block meets every block.

    The work grows with the square of the nodes; what comes out is a forest of each two blocks.
    """
    blocks = max(1, math.ceil(nodes.count() / MEETING))
    own = nodes.selectExpr("id", "raw", f"CAST(pmod(xxhash64(id), {blocks}) AS INT) AS own", f"explode(sequence(0, {blocks - 1})) AS other")
    groups = own.selectExpr("least(own, other) AS i", "greatest(own, other) AS j", "id", "raw").groupBy("i", "j").agg(
        F.collect_list(F.struct("id", "raw")).alias("members"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                ids, raws = members.values.field("id").to_numpy(), members.values.field("raw").to_pylist()
                for width in {len(r) for r in raws}:
                    at = np.array([i for i, r in enumerate(raws) if len(r) == width])
                    rows = unit_rows([raws[i] for i in at])
                    linked = rows @ rows.T >= threshold
                    np.fill_diagonal(linked, False)
                    linked |= linked.T  # sums may be rounded differently on the two sides
                    one, two = _forest(linked, np.zeros_like(linked))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][one]), pa.array(ids[at][two])], names=["a", "b"])

    return groups.select("members").mapInArrow(meet, "a bigint, b bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding",
                    seed: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a vector.

    n_links counts the other vectors with a cosine of at least ``threshold`` (in double precision) that were found, component_id is
    the smallest vec_id reachable over links, kept tells vectors that are their component's smallest. Vectors that are null, zero, empty or hold
    null or non-finite components have no links. All links are found where the audit covered all vectors, or failed and all were compared; else the audited
    recall is at least LEAST_RECALL (logged, with the number of nodes that it rests on) and single links may be missing. Repeated rows are vectors of their own; rows without vec_id link but name no component.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = cut_lineage(usable_vectors(vectors, id_col, vector_col))
    # Rows of a class are told apart by a number: vec_id may repeat or be missing.
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"), F.first("half").alias("half"))
    nodes = cut_lineage(classes.withColumn("id", F.coalesce("least", F.xxhash64("key"))))
    # One vec_id on different vectors: all but the first go by a number of their own.
    twice = Window.partitionBy("id").orderBy("key")
    nodes = cut_lineage(nodes.withColumn("id", F.when(F.row_number().over(twice) > 1, F.xxhash64("key", "id")).otherwise(F.col("id"))))
    count, least = nodes.count(), threshold - MARGIN
    fresh = first_neighbours(nodes, k, least, seed)
    links = audit = None
    for doubling in range(DOUBLINGS + 1):
        found = cut_lineage(fresh)
        links = cut_lineage(_linked(found, links))
        old = None if doubling == 0 else lists.withColumn("fresh", F.lit(True))  # noqa: F821
        pairs = found.where("NOT link").select("id", "other", "score", F.lit(True).alias("fresh"))
        lists = cut_lineage(best(pairs if old is None else pairs.unionByName(old), k))
        for _ in range(ROUNDS):
            found = cut_lineage(refined(nodes, lists, k, least))
            links = cut_lineage(_linked(found, links))
            pairs = found.where("NOT link").select("id", "other", "score", F.lit(True).alias("fresh"))
            lists = cut_lineage(best(lists.withColumn("fresh", F.lit(False)).unionByName(pairs), k))
            if lists.where("fresh").count() <= STILL * count * k:
                break
        near = lists.where(F.col("score") >= least).selectExpr("least(id, other) AS a", "greatest(id, other) AS b")
        exact = exact_links(links.unionByName(near).distinct(), nodes, threshold)
        joined, inner = _counted(exact, nodes, threshold)
        audit = audit or Audit(nodes, threshold, seed=seed)
        share = audit.recall(inner)
        logging.getLogger(__name__).info("recall of the %d audited nodes that have links: %.4f", len(audit.true), share)
        if share < 1 and (share >= LEAST_RECALL or audit.complete):
            # What the audit met and the search had lost is linked too.
            joined, inner = _counted(cut_lineage(exact.unionByName(audit.links).distinct()), nodes, threshold)
            share = audit.recall(inner) if audit.complete else share
        if share >= LEAST_RECALL:
            break
        k, seed = 2 * k, seed + 1
        fresh = first_neighbours(nodes, k, least, seed)
    else:
        logging.getLogger(__name__).warning("recall of the audited sample stayed at %.4f: all %d vectors are compared", share, count)
        joined, inner = _counted(cut_lineage(all_pairs(nodes, threshold)), nodes, threshold)
    named = nodes.select("key", "id", "least", "copies").join(joined.selectExpr("node AS id", "component"), "id", "left").join(
        inner, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(smallest, "component").select("key", "component_id", F.coalesce("links", F.col("copies") - 1).alias("n_links"))
    return rows.select("vec_id", "key").join(told, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))


def _counted(links: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, component) of ``links``, and (id, links) within the components."""
    joined = components(links)
    members = joined.selectExpr("node AS id", "component").join(nodes.select("id", "copies", "raw"), "id")
    return joined, cut_lineage(links_within(members.select("component", "id", "copies", "raw"), threshold))


def _linked(found: DataFrame, links: DataFrame | None) -> DataFrame:
    own = found.where("link").selectExpr("least(id, other) AS a", "greatest(id, other) AS b")
    return (own if links is None else own.unionByName(links)).distinct()
