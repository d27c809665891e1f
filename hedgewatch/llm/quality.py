"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal distribution of the statistics; its covariance is shrunk towards its diagonal and towards the
covariance of both classes. A score is the posterior of class 1 from the difference of Mahalanobis distances and log
determinants; the inverse Cholesky factors are computed once and sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.llm.common import quoted, replaced, slices_of_lengths, slices_of_texts, texts_of

STATISTICS = ("characters", "words", "word_length", "word_spread", "upper", "digit", "sign", "accent", "line_length",
              "distinct_words", "commonest_word", "signed_words", "title_words", "stops", "repeated_lines", "long_words")
#: Shrinkage to the class's own diagonal, and to both classes' covariance; least variance; rejected below this score.
SHRINK_DIAGONAL, SHRINK_POOLED, LEAST_VARIANCE, REJECT = 0.05, 0.1, 1e-4, 0.7
#: Log odds are divided by this before they become a score: statistics of a text are not independent draws.
TEMPERATURE = 2.0
#: A short text says little: shares are taken as if so many usual characters, words and lines were added to every text.
SOME_CHARACTERS, SOME_WORDS, SOME_LINES = 100, 20, 20
USUAL_LENGTH, USUAL_SPREAD, USUAL_TITLES, USUAL_STOPS = 5.5, 3.0, 0.1, 0.1
#: Characters measured at a time: some 40 bytes of arrays each.
CHARS_AT_ONCE = 500_000
_KINDS = np.zeros(0x250, np.int64)  # 0 other, 1 blank, 2 upper, 3 lower, 4 digit, 5 sign, 6 accented letter, 7 line end
for _c in range(0x250):
    _s = chr(_c)
    _KINDS[_c] = (7 if _s == "\n" else 1 if _s.isspace() else 6 if _c > 127 and _s.isalpha() else 2 if _s.isupper() else 3 if _s.isalpha()
                  else 4 if _s.isdigit() else 5 if 32 < _c < 127 else 0)


def statistics_of(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each whole text, all finite; zero counts for an empty text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    kinds = np.where(points < 0x250, _KINDS[np.minimum(points, 0x24F)], 6)
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), counts)
    share = np.bincount(owner * 8 + kinds, minlength=8 * len(texts)).reshape(-1, 8)
    rows = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        words = text.split()
        tally = Counter(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lines = [x for x in text.split("\n") if x.strip()]
        signed = sum(c for w, c in tally.items() if not (w[-1].isalnum() or w[-1] in ".,;:?"))
        title = sum(c for w, c in tally.items() if w[0].isupper() and w[1:].islower())
        stops = text.count(". ") + text.count(".\n") + text.endswith(".")
        n, m, k = len(text) + SOME_CHARACTERS, len(words) + SOME_WORDS, len(lines) + SOME_LINES
        mean = (lengths.sum() + SOME_WORDS * USUAL_LENGTH) / m
        spread = np.sqrt((np.square(lengths - mean).sum() + SOME_WORDS * USUAL_SPREAD ** 2) / m)
        rows[i] = (
            np.log1p(len(text)), np.log1p(len(words)), np.log(mean), np.log(spread),
            *np.sqrt(share[i, [2, 4, 5, 6]] / n), np.log1p((len(text) + SOME_LINES * 200) / k),
            (len(tally) + SOME_WORDS) / m, np.sqrt(max(0, max(tally.values(), default=0) - 1) / m), np.sqrt(signed / m),
            np.sqrt((title + SOME_WORDS * USUAL_TITLES) / m), np.sqrt((stops + SOME_WORDS * USUAL_STOPS) / m),
            np.sqrt((len(lines) - len(set(lines))) / k), np.sqrt(np.count_nonzero(lengths > 20) / m))
    return rows


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "statistics", keep_text: bool = False) -> DataFrame:
    """``docs`` with an array of statistics in place of the text (or beside it). Null text counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            rows = [statistics_of(texts[a:b]) for a, b in slices_of_texts(texts, CHARS_AT_ONCE)]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)
            batch = replaced(batch, {name: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})
            yield batch if keep_text else batch.drop_columns([text_col])

    kept = [f for f in docs.schema if f.name != name and (keep_text or f.name != text_col)]
    return docs.mapInArrow(measure, T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """Means, inverse Cholesky factors and log densities' constants of classes 0 and 1; or a constant score."""

    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    constant_score: float | None = None
    temperature: float = TEMPERATURE

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Score of class 1 for each row of statistics, in 0 to 1."""
        if self.constant_score is not None:
            return np.full(len(rows), self.constant_score)
        density = [c - 0.5 * np.square((rows - m) @ w.T).sum(axis=1)
                   for m, w, c in zip(self.means, self.inverses, self.constants, strict=True)]
        odds = np.clip((density[1] - density[0]) / self.temperature, -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(labelled: DataFrame, label: str = "quality", name: str = "statistics", text_col: str | None = None) -> Model:
    """Fit on every row of ``labelled`` with label 0 or 1 (others are left out), from its statistics or, with ``text_col``, from its texts.

    Only sums leave the tasks: one row per class and entry of the moments, added up in Spark. Where a class has too few rows
    for a covariance (fewer than 2), the score is the constant (rows of class 1 + 1) / (rows + 2).
    """
    width = len(STATISTICS)

    def measured(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        if text_col is None:
            yield 0, batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return
        texts = batch.column(text_col)
        for a, b in slices_of_lengths(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False), CHARS_AT_ONCE):
            yield a, statistics_of([t or "" for t in texts.slice(a, b - a).to_pylist()])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            every = batch.column("mark").to_numpy(zero_copy_only=False)
            for begin, rows in measured(batch):
                marks = every[begin:begin + len(rows)]
                for k in (0, 1):
                    own = rows[marks == k]
                    total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        entries = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(entries), pa.array(total.ravel()[entries])], names=["entry", "part"])

    usable = f"`{name}` IS NOT NULL" if text_col is None else "true"
    rows = labelled.select(quoted(text_col or name), quoted(label).cast("int").alias("mark")).where(f"mark IN (0, 1) AND {usable}")
    sums = rows.mapInArrow(moments, "entry bigint, part double").groupBy("entry").agg(F.sum("part").alias("total"))
    total = np.zeros(2 * (1 + width + width * width))
    for entry, value in sums.collect():  # at most as many rows as there are moments
        total[entry] = value
    n, first, second = np.split(total.reshape(2, -1), [1, 1 + width], axis=1)
    n = n[:, 0]
    if min(n) < 2:
        return Model(np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2), float((n[1] + 1) / (n.sum() + 2)))
    means = first / n[:, None]
    own = second.reshape(2, width, width) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    shrunk = [(1 - SHRINK_DIAGONAL - SHRINK_POOLED) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + SHRINK_POOLED * pooled
              + LEAST_VARIANCE * np.eye(width) for s in own]
    factors = [np.linalg.cholesky(s) for s in shrunk]
    constants = [np.log(c / n.sum()) - np.log(np.diag(f)).sum() for c, f in zip(n, factors, strict=True)]
    return Model(means, np.array([np.linalg.inv(f) for f in factors]), np.array(constants))


def with_scores(measured: DataFrame, model: Model, name: str = "statistics", out: str = "score") -> DataFrame:
    """Adds ``out`` in place of the statistics; null statistics score as those of an empty text."""
    figures = vars(model)  # a fixed number of them, sent with the function

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, known = statistics_of([""])[0], Model(**figures)
        for batch in batches:
            rows = [empty if r is None else r for r in batch.column(name).to_pylist()]
            values = known.scores(np.array(rows, float).reshape(-1, len(STATISTICS)))
            yield replaced(batch.drop_columns([name]), {out: pa.array(values)})

    kept = [f for f in measured.schema if f.name not in (name, out)]
    return measured.select(*[quoted(f.name) for f in kept], quoted(name)).mapInArrow(
        score, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def text_score(model: Model, text_col: str = "text") -> Column:
    """The score of each whole text; null text counts as empty. Only texts go to the worker and only scores come back; a text is
    measured by itself, so a worker holds the words of one text whatever the size of a batch."""
    figures = vars(model)  # a fixed number of them, sent with the function

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(**figures)
        for texts in batches:
            lengths = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            values = [known.scores(statistics_of([t or "" for t in texts.slice(a, b - a).to_pylist()]))
                      for a, b in slices_of_lengths(lengths, CHARS_AT_ONCE)]
            yield pa.array(np.concatenate(values) if values else np.zeros(0))

    return scored(quoted(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model is fitted on."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, most: int, label: str = "quality") -> DataFrame:
    """At most ``most`` labels to fit on (those with the smallest hash of doc_id). Labels without document or value, or not 0 or 1, and held-out
    rows are left out."""
    marks = labels.select("doc_id", quoted(label).cast("int").alias(label)).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    return marks.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(most)


def training_rows(measured: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics and label of the rows to fit on. Labels without document or value, and held-out rows, are left out."""
    marks = labels.select("doc_id", quoted(label).alias(label)).where(F.col(label).isNotNull() & ~held_out())
    return measured.select("doc_id", "statistics").join(marks, "doc_id").select("statistics", label)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label: str = "quality", cut=lambda df: df) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text: one row a document, empty and null texts too.

    Rows without doc_id are scored and not fitted on; repeated rows count as often as they come. ``cut`` may write the statistics once.
    """
    measured = cut(with_statistics(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))))
    model = fit(training_rows(measured, labels, label), label)
    return with_scores(measured, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
