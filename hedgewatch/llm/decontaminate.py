"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Items become word sequences; one automaton accepts every run of words of any of them. Documents stream through it: each word
either extends the run matched so far or shortens it along suffix links, so the longest matching length is known at every word. Where it
reaches the window, the automaton's state says which items hold those words. Words that no item has, and neighbours that
no item has side by side, end every match, so only stretches without them are streamed.

An automaton holds a bounded number of words and is built in a task. More items give more automata; documents then pass once for each, and
what they find is put together per document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.llm.common import quoted, replaced, slices_of_lengths
from hedgewatch.session import cut_lineage

#: Consecutive words of an item that count as its passage; an item of fewer is one passage.
WINDOW = 10
#: Words of items in one automaton (some 100 MB in a task), and of a segment that a longer item is cut into.
AUTOMATON_WORDS, SEGMENT_WORDS = 250_000, 10_000
#: Bytes of text that a task holds as words at a time.
BYTES_AT_ONCE = 2_000_000
#: A document goes if more than this share of its words is hit; else runs of at least so many hit words go.
COVERAGE, LEAST_RUN = 0.5, WINDOW
# A-Z become a-z; of the other ASCII characters only digits and a-z are part of a word.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Fixed value: a word before A-Z are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of word sequences, added one after another with ``add``."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, transitions: dict[int, int], link: int, length: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that ``state`` goes to by ``word``, with runs of one more word only: cloned where it also has longer ones."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:  # another sequence has this run
                last = self._split(last, word)
                continue
            fresh, state = self._state({}, 0, self.length[last] + 1), last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = fresh
                state = self.link[state]
            if state >= 0:
                self.link[fresh] = self._split(state, word)
            last = fresh

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        after = self.next[state].get(word)
        return (0, 0) if after is None else (after, length + 1)


class Passages:
    """An automaton with what a search needs: word numbers, neighbours, and the items behind a state."""

    def __init__(self, segments: list[tuple[str | None, bool, list[bytes]]], window: int = WINDOW):
        """``segments``: item, whether it is a whole short item, words."""
        self.window = window
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, _, words in segments for w in words))}
        automaton = self.automaton = Automaton()
        rows = [[self.number[w] for w in words] for _, _, words in segments]
        for row in rows:
            automaton.add(row)
        self.at_window = self._states_of_length(window)
        self.least = min([window, *[len(r) for r in rows]])
        self.items: dict[int, set[str]] = {}                       # state that holds a window -> items
        self.short: dict[int, dict[int, set[str]]] = {}            # state that holds a short item -> its length -> items
        pairs = set()
        for (item, short, _), row in zip(segments, rows, strict=True):
            state = length = 0
            for word in row:
                state, length = automaton.step(state, length, word)
                if length >= window:
                    self.items.setdefault(self.at_window[state], set()).update([item] if item is not None else ())
            if short:
                self.short.setdefault(state, {}).setdefault(len(row), set()).update([item] if item is not None else ())
            pairs.update(a * len(self.number) + b for a, b in zip(row, row[1:]))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.short_above = self._nearest_short()

    def _states_of_length(self, length: int) -> list[int]:
        """For each state the one on its suffix path that holds the run of ``length`` words, or -1."""
        found = [-1] * len(self.automaton.link)
        for state in np.argsort(self.automaton.length, kind="stable").tolist():
            if self.automaton.length[state] >= length:
                above = self.automaton.link[state]
                found[state] = state if self.automaton.length[above] < length else found[above]
        return found

    def _nearest_short(self) -> list[int]:
        """For each state the next one on its suffix path, itself included, that holds a short item, or -1."""
        found = [-1] * len(self.automaton.link)
        for state in np.argsort(self.automaton.length, kind="stable").tolist():
            if state:
                found[state] = state if state in self.short else found[self.automaton.link[state]]
        return found

    def numbers(self, text: bytes) -> np.ndarray:
        """Number of every word of a whole text; -1 for a word that no item has."""
        parts, begin = [], 0
        folded = text.translate(_FOLD)
        while begin < len(folded):
            end = folded.find(b" ", begin + BYTES_AT_ONCE)
            end = len(folded) if end < 0 else end
            words = folded[begin:end].split()
            parts.append(np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words)))
            begin = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def stretches(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words that can hold a passage: every word, and every two neighbours, stand so in some item."""
        known = numbers >= 0
        if np.count_nonzero(known) < self.least:
            return
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= self.least].tolist():
            if b - a > 1:
                keys = numbers[a:b - 1].astype(np.int64) * len(self.number) + numbers[a + 1:b]
                at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
                broken = np.flatnonzero(self.pairs[at] != keys) + a + 1 if len(self.pairs) else np.arange(a + 1, b)
            else:
                broken = np.zeros(0, np.int64)
            for x, y in zip([a, *broken.tolist()], [*broken.tolist(), b], strict=True):
                if y - x >= self.least:
                    yield x, y

    def search(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, end), disjoint and in order, and the items whose passages occur."""
        hits, items = [], set()
        step, seen = self.automaton.step, set()
        for a, b in self.stretches(numbers):
            state = length = 0
            for at, word in enumerate(numbers[a:b].tolist(), a + 1):
                state, length = step(state, length, word)
                own = 0
                if length >= self.window:
                    own = self.window
                    seen.add(self.at_window[state])
                above = self.short_above[state]
                while above >= 0:
                    for size, names in self.short[above].items():
                        if size <= length:
                            own = max(own, size)
                            items |= names
                    above = self.short_above[self.automaton.link[above]]
                if own:
                    first = at - own
                    while hits and hits[-1][0] >= first:
                        hits.pop()
                    if hits and hits[-1][1] >= first:
                        hits[-1] = (hits[-1][0], at)
                    else:
                        hits.append((first, at))
        for state in seen:
            items |= self.items[state]
        return hits, items


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(part, passages binary): automata of at most ``most`` words, and one segment, each. Items without words give none.

    Longer items are cut into segments that share ``window - 1`` words, so every window lies in one.
    """
    rows = items.select(quoted(id_col).cast("string").alias("item"), quoted(text_col).cast("string").alias("text"))
    count = rows.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0
        place = TaskContext.get().partitionId()

        def flushed() -> pa.RecordBatch:
            passages = Passages(held, window)
            return pa.RecordBatch.from_arrays([pa.array([place << 32 | count], pa.int64()), pa.array([pickle.dumps(vars(passages) | {
                "automaton": vars(passages.automaton)})], pa.binary())], names=["part", "passages"])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of((text or "").encode())
                for begin in range(0, max(1, len(words) - window + 1), SEGMENT_WORDS):
                    own = words[begin:begin + SEGMENT_WORDS + window - 1]
                    if own:
                        held.append((item, len(words) < window, own))
                        size += len(own)
                    if size >= most:
                        yield flushed()
                        held, size, count = [], 0, count + 1
        if held:
            yield flushed()

    return rows.repartition(max(1, -(-count // most))).mapInArrow(build, "part bigint, passages binary")


def _opened(blob: bytes) -> Passages:
    """Plain containers travel: executors have no copy of this package."""
    figures = pickle.loads(blob)
    passages, automaton = Passages.__new__(Passages), Automaton.__new__(Automaton)
    vars(automaton).update(figures.pop("automaton"))
    vars(passages).update(figures, automaton=automaton)
    return passages


_FOUND = [T.StructField("_dec_words", T.LongType()), T.StructField("_dec_hits", T.ArrayType(T.ArrayType(T.IntegerType()))),
          T.StructField("_dec_items", T.ArrayType(T.StringType()))]


def _searched(docs: DataFrame, blob: bytes, text_col: str, keep_text: bool, only_hits: bool) -> DataFrame:
    """``docs`` with its number of words, runs of hit words and items, as one automaton finds them."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)  # at most an automaton of bounded size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = _opened(shared.value)
        for whole in batches:
            sizes = pc.binary_length(whole.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices_of_lengths(sizes, BYTES_AT_ONCE):
                batch = whole.slice(a, b - a)
                counts, hits, names = [], [], []
                for text in batch.column(text_col).cast(pa.binary()):
                    numbers = passages.numbers(text.as_py() or b"")
                    runs, items = passages.search(numbers)
                    counts.append(len(numbers))
                    hits.append([list(r) for r in runs])
                    names.append(sorted(items))
                batch = replaced(batch, {"_dec_words": pa.array(counts, pa.int64()), "_dec_hits": pa.array(hits, pa.list_(pa.list_(pa.int32()))),
                                         "_dec_items": pa.array(names, pa.list_(pa.string()))})
                if only_hits:
                    batch = batch.filter(pa.array([bool(h) for h in hits], pa.bool_()))
                yield batch if keep_text else batch.drop_columns([text_col])

    kept = [f for f in docs.schema if keep_text or f.name != text_col]
    return docs.mapInArrow(search, T.StructType([*kept, *_FOUND]))


def _merged(lists: pa.Array) -> pa.Array:
    """Runs of several searches as disjoint runs in order."""
    out = []
    for runs in lists.to_pylist():
        own = []
        for first, end in sorted(runs or ()):
            if own and own[-1][1] >= first:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([first, end])
        out.append(own)
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def with_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", keep_text: bool = True, window: int = WINDOW,
              most: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` with ``_dec_words`` (words of the whole text), ``_dec_hits`` (runs of hit words, first and end, disjoint, in order) and
    ``_dec_items`` (items whose passages occur, sorted as strings).

    ``items`` has (item_id, text). Null and empty texts have no words; items without words hit nothing; an item without id hits
    and is not named; repeated rows, of either table, count like one item and are answered each. Columns whose names begin with ``_dec_``
    are not allowed.
    """
    if any(c.startswith("_dec_") for c in docs.columns):
        raise ValueError("the input has a column of a reserved name")
    parts = cut_lineage(automata(items, window=window, most=most))
    names = [r[0] for r in parts.select("part").orderBy("part").limit(2).collect()]
    if len(names) < 2:
        blob = parts.first()["passages"] if names else pickle.dumps(_no_passages(window))
        return _searched(docs, blob, text_col, keep_text, only_hits=False)
    # More than one automaton: rows are named once, pass once for each, and only rows with hits are put together.
    rows = cut_lineage(docs.withColumn("_dec_row", F.monotonically_increasing_id()))
    found = None
    for part in parts.toLocalIterator():  # one automaton on the driver at a time
        own = cut_lineage(_searched(rows.select("_dec_row", quoted(text_col)), part["passages"], text_col, False, True))
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy("_dec_row").agg(F.expr("flatten(collect_list(_dec_hits))").alias("_dec_hits"), F.expr(
        "array_sort(array_distinct(flatten(collect_list(_dec_items))))").alias("_dec_items")).withColumn(
        "_dec_hits", F.arrow_udf(_merged, "array<array<int>>")("_dec_hits"))
    counted = _searched(rows, pickle.dumps(_no_passages(window)), text_col, keep_text, only_hits=False).drop("_dec_hits", "_dec_items")
    joined = counted.join(merged, "_dec_row", "left")
    return joined.select(*[quoted(c) for c in docs.columns if keep_text or c != text_col], "_dec_words", F.expr(
        "coalesce(_dec_hits, array())").alias("_dec_hits"), F.expr("coalesce(_dec_items, array())").alias("_dec_items"))


def _no_passages(window: int) -> dict:
    passages = Passages([], window)
    return vars(passages) | {"automaton": vars(passages.automaton)}


def remove_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", least_run: int = LEAST_RUN, coverage: float = COVERAGE,
                    window: int = WINDOW, most: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` without what they share with the items: documents of which more than ``coverage`` of the words is hit go; of the
    others, runs of at least ``least_run`` hit words go, with what stands between these words. Clean texts stay as they are."""
    found = with_hits(docs, items, text_col, True, window, most).where(
        f"_dec_words = 0 OR aggregate(_dec_hits, 0L, (n, r) -> n + r[1] - r[0]) <= {coverage} * _dec_words")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _without(t, [r for r in own if r[1] - r[0] >= least_run])
                         for t, own in zip(texts.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

    hit = F.size("_dec_hits") > 0  # clean texts stay in the JVM
    return found.withColumn(text_col, F.coalesce(cut(F.when(hit, quoted(text_col)), F.when(hit, F.col("_dec_hits"))), quoted(text_col))).select(
        *[quoted(c) for c in docs.columns])


def _without(text: str, runs: list[list[int]]) -> str:
    """``text`` without runs of words and the characters between them."""
    if not runs:
        return text
    raw = text.encode()
    marks = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))).reshape(-1, 2)
    parts, at = [], 0
    for first, end in runs:
        parts.append(raw[at:edge[first, 0]])
        at = edge[end - 1, 1]
    return b"".join([*parts, raw[at:]]).decode()


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, hit words, and the items whose passages occur, as a number and a digest."""
    found = with_hits(docs.select("doc_id", "text"), items, keep_text=False)
    hit = F.expr("aggregate(_dec_hits, 0L, (n, r) -> n + r[1] - r[0])")
    return found.select(
        "doc_id", F.col("_dec_words").alias("n_words"), hit.alias("n_hit"), F.size("_dec_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_dec_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
