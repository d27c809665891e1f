"""Embedding whitening: projection on the leading components of the vectors' covariance, scaled to unit variance.

Two passes add up what the tasks find: exact integer sums, then products of centred entries. The covariance (one matrix of the vectors' width) is
reduced to a tridiagonal one by Householder reflections; Sturm counts bisect for its leading eigenvalues, inverse iteration finds their
vectors, and those of one cluster of eigenvalues are made orthogonal to each other. The components go to the tasks, which project.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.llm.common import quoted

#: Entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Widest vectors that are taken: the covariance is held by the driver and, in turn, by each task.
WIDEST = 4096
#: Entries from here on are held at this size; whole numbers up to here are exact in double precision.
LARGEST = 1 << 52
#: Eigenvalues closer than this share of the matrix's norm form a cluster; below this share of the trace there is no variance to scale.
CLUSTER, NO_VARIANCE = 1e-3, 1e-13
#: Rows in a task at a time.
ROWS_AT_ONCE = 4096
_EPS = float(np.finfo(float).eps)


def entries_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as they are where they are floating-point numbers, else as doubles."""
    kind = vectors.schema[vector_col].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    vector = quoted(vector_col) if plain else quoted(vector_col).cast("array<double>")
    return vectors.select(quoted(id_col).alias("vec_id"), vector.alias("x"))


def _rows(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of usable vectors, some at a time, and floor(SCALE * c) + SHIFT of their entries; shorter vectors end in entries of zero.

    Null vectors and those with a null or non-finite entry are left out. Without ``width``, rows are as wide as the widest of them.
    """
    for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.column("x").slice(begin, ROWS_AT_ONCE)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
        fit = part.is_valid().to_numpy(zero_copy_only=False).copy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        fit[owner[~np.isfinite(flat)]] = False
        whole = np.floor(np.clip(flat[fit[owner]] * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
        lengths = lengths[fit]
        wide = int(lengths.max(initial=0)) if width is None else width
        if wide > WIDEST:
            raise ValueError(f"a vector has more than {WIDEST} entries")
        rows = np.full((len(lengths), wide), SHIFT, np.int64)
        rows[np.arange(wide)[None, :] < lengths[:, None]] = whole
        yield np.flatnonzero(fit) + begin, rows


@dataclass
class Centre:
    """Number of vectors and exact sums of their entries."""

    n: int
    sums: list[int]

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or whole Python numbers where these could be too small."""
        most = max(int(np.abs(rows).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 1 << 61:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S / n in double precision: centred as whole numbers, so nothing cancels."""
        exact = self.deviations(rows)
        if exact.dtype == object:
            return np.array([[v / self.n for v in r] for r in exact], float).reshape(rows.shape)
        return exact / self.n

    def squares(self, rows: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)^2, exact; beyond the range of longs the largest long."""
        exact = self.deviations(rows)
        if exact.dtype != object and float(np.abs(exact).max(initial=0)) ** 2 * rows.shape[1] < 2.0 ** 62:
            return np.square(exact).sum(axis=1).tolist()
        largest = (1 << 63) - 1
        return [min(largest, sum(v * v for v in map(int, r))) for r in exact]


def centre(entries: DataFrame) -> Centre:
    """Sums over all rows. Partial sums leave the tasks as two longs an entry, which 2^31 rows of a task cannot overflow."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros((0, 2), np.int64)
        for batch in batches:
            for _, rows in _rows(batch):
                more = max(0, rows.shape[1] - len(sums))  # rows before this had entries of zero there
                sums = np.concatenate((sums, np.tile((count * SHIFT >> 32, count * SHIFT & 0xFFFFFFFF), (more, 1)).reshape(-1, 2)))
                part = np.stack(((rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)), axis=1)
                sums[:len(part)] += part
                sums[len(part):, 1] += len(rows) * SHIFT
                count += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([count, *([count] * len(sums))], pa.int64()),
                                          pa.array([0, *sums[:, 0].tolist()], pa.int64()), pa.array([0, *sums[:, 1].tolist()], pa.int64())],
                                         names=["entry", "rows", "high", "low"])

    kind = "decimal(38,0)"
    totals = entries.select("x").mapInArrow(add, "entry int, rows bigint, high bigint, low bigint").groupBy("entry").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("high").cast(kind)).alias("high"), F.sum(F.col("low").cast(kind)).alias("low"))
    found = {r["entry"]: r for r in totals.collect()}  # a row for each of at most WIDEST entries
    n = int(found[-1]["rows"]) if -1 in found else 0
    # Tasks that never saw an entry had zeros there.
    sums = [(int(found[i]["high"]) << 32) + int(found[i]["low"]) + (n - int(found[i]["rows"])) * SHIFT for i in range(len(found) - 1)]
    return Centre(n, sums)


def mean_products(rows: DataFrame, width: int, given: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the centred entries or of what ``project`` makes of them, which is centred like them.

    A task sends one triangle of its own sum; a task's products are doubles of its rows alone.
    """
    figures, above = vars(given), np.triu_indices(width if project is None else project.shape[1])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = np.zeros((len(above[0]),)), Centre(**figures)
        for batch in batches:
            for _, part in _rows(batch, width):
                values = known.centred(part)
                values = values if project is None else values @ project
                own += (values.T @ values)[above]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["entry", "part"])

    total = np.zeros(len(above[0]))
    for entry, value in rows.select("x").mapInArrow(multiply, "entry int, part double").groupBy("entry").agg(F.sum("part")).collect():
        total[entry] = value  # one row for each entry of the triangle
    size = width if project is None else project.shape[1]
    full = np.zeros((size, size))
    full[above] = total / given.n
    return full + np.triu(full, 1).T


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix: Householder vectors as columns, of length sqrt(2) or zero."""
    a, n = matrix.astype(float).copy(), len(matrix)
    reflections = np.zeros((n, max(0, n - 2)))
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) <= _EPS * size * 1e-3:
            continue
        x[0] += math.copysign(size, x[0])
        x *= math.sqrt(2) / np.linalg.norm(x)
        reflections[k + 1:, k] = x
        # A is reflected on both sides: A - x w' - w x'.
        p = a[k + 1:, k + 1:] @ x
        w = p - (x @ p) / 2 * x
        a[k + 1:, k + 1:] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1:, k] -= x * (x @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value of ``at``: how many eigenvalues are below it."""
    least = _EPS * max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    below = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < least * _EPS, -least * _EPS, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling: all are bisected together between Gershgorin's bounds."""
    n = len(diagonal)
    around = np.concatenate((np.abs(off), [0])) + np.concatenate(([0], np.abs(off)))
    low, high = np.full(count, (diagonal - around).min()), np.full(count, (diagonal + around).max())
    margin = _EPS * max(abs(low[0]), abs(high[0])) * n + np.finfo(float).tiny
    low, high = low - margin, high + margin
    wanted = n - np.arange(count)  # the i-th largest has fewer than this many below it
    for _ in range(200):
        middle = (low + high) / 2
        enough = sturm_counts(diagonal, off, middle) >= wanted
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        if (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a pivot of zero becomes a tiny one."""
    n = len(diagonal)
    tiny = _EPS * max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    rows = np.zeros((n, 3))  # what is left of each row from its pivot on
    b = right.astype(float).copy()
    own = np.array([diagonal[0] - shift, off[0] if n > 1 else 0, 0.0])
    for i in range(n - 1):
        below = np.array([off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(own[0]):
            own, below = below, own
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(own[0]) < tiny:
            own[0] = math.copysign(tiny, own[0])
        factor = below[0] / own[0]
        rows[i] = own
        b[i + 1] -= factor * b[i]
        own = np.array([below[1] - factor * own[1], below[2] - factor * own[2], 0.0])
    if abs(own[0]) < tiny:
        own[0] = math.copysign(tiny, own[0])
    rows[n - 1] = own
    for i in range(n - 1, -1, -1):
        rest = rows[i, 1] * b[i + 1] if i + 1 < n else 0.0
        rest += rows[i, 2] * b[i + 2] if i + 2 < n else 0.0
        b[i] = (b[i] - rest) / rows[i, 0]
        if abs(b[i]) > 1e150:  # only the direction matters
            b /= abs(b[i])
    return b


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (columns) of falling ``values`` by inverse iteration; within a cluster each is made orthogonal to those before it."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0)) or 1.0
    draw = np.random.default_rng(0)
    found = np.zeros((n, len(values)))
    first, shift = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal eigenvalues are shifted apart a little, or all would find one vector.
        shift = value if k == first or shift is None else min(value, shift - 4 * _EPS * norm)
        cluster = found[:, first:k]
        x = draw.standard_normal(n)
        for turn in range(12):
            x -= cluster @ (cluster.T @ x)
            x /= np.linalg.norm(x)
            before, x = x, _solve(diagonal, off, shift, x)
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
            size = np.linalg.norm(x)
            if not size:
                x = draw.standard_normal(n)
                continue
            x /= size
            if turn > 1 and min(np.abs(x - before).max(), np.abs(x + before).max()) < 1e-14:
                break
        found[:, k] = x
    return found


def leading_components(covariance: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns: at most ``count``, none without variance.

    Each value is the vector's own Rayleigh quotient, so that both fit each other to double precision.
    """
    n = len(covariance)
    trace = float(np.trace(covariance))
    if not n or trace <= 0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, off, reflections = tridiagonal(covariance / trace)
    values = leading_eigenvalues(diagonal, off, min(count, n))
    values = values[values > NO_VARIANCE]
    vectors = eigenvectors(diagonal, off, values)
    for k in range(reflections.shape[1] - 1, -1, -1):
        x = reflections[:, k]
        vectors -= np.outer(x, x @ vectors)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation long, whitened array<double>, explained array<double>, identity_error double), a row for each vector.

    Vectors that are null or hold null or non-finite entries are left out; shorter ones (empty ones too) end in entries of zero; rows without id
    and repeated rows count and come back as they are. Where the covariance has fewer components with variance, the arrays are shorter,
    down to empty for a table of equal vectors or of one. An empty table gives no rows. Entries beyond 2^46 count as 2^46; a deviation beyond
    the longs is the largest long. Other columns are not looked at. The input is read four times; only sums leave the tasks.
    """
    entries = entries_of(vectors, id_col, vector_col)
    given = centre(entries)
    width = len(given.sums)
    covariance = mean_products(entries, width, given) if width and given.n else np.zeros((0, 0))
    values, axes = leading_components(covariance, components)
    project, error = axes / np.sqrt(values), 0.0
    if len(values):
        error = float(np.abs(mean_products(entries, width, given, project) - np.eye(len(values))).max())
    figures, shares = vars(given), (values / np.trace(covariance)).tolist()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Centre(**figures)
        for batch in batches:
            for places, rows in _rows(batch, width):
                whitened = known.centred(rows) @ project if len(shares) else np.zeros((len(rows), 0))
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * whitened.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(places)), pa.array(known.squares(rows), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel()))], names=["vec_id", "deviation", "whitened"])

    kind = T.StructType([T.StructField("vec_id", entries.schema["vec_id"].dataType), T.StructField("deviation", T.LongType()),
                         T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return entries.mapInArrow(apply, kind).select(
        "vec_id", F.lit(given.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
