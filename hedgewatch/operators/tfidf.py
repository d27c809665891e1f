"""Character n-grams within words and their TF-IDF weights, relationally."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch import config
from hedgewatch.functions.text import SPACE


def words(text: Column) -> Column:
    """Words of the lower-cased text. ``text`` should be a plain column."""
    low = F.lower(text)
    plain = F.length(text) == F.octet_length(text)  # ASCII needs no Unicode classes
    parts = F.when(plain, F.split(low, f"{SPACE}+")).otherwise(F.split(low, f"(?U){SPACE}+"))
    return F.filter(parts, lambda w: w != "")


def _ngrams_of(listed: Column, low: int, high: int) -> Column:
    def of_word(word: Column) -> Column:
        size = F.length(word)
        sizes = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), size)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)),
            lambda at: F.substring(word, at, n))))

    padded = F.transform(listed, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, of_word))


def word_ngrams(text: Column, low: int = config.NGRAM_MIN, high: int = config.NGRAM_MAX) -> Column:
    """All character n-grams of the lower-cased text, word by word, each word padded
    with a blank on both sides. A padded word no longer than n is given once and
    ends that word."""
    return _ngrams_of(words(text), low, high)


#: Terms that a task remembers; documents, and words of them, that are counted together.
TERMS, DOCUMENTS_AT_ONCE, WORDS_AT_ONCE = 500_000, 256, 200_000


class _Grams:
    """The n-grams of words as numbers, for one task."""

    def __init__(self, low: int = config.NGRAM_MIN, high: int = config.NGRAM_MAX):
        self.low, self.high, self.round = low, high, 0
        self.terms: dict[str, int] = {}
        self.names: list[str] = []

    def full(self) -> bool:
        return len(self.terms) > TERMS

    def forget(self) -> None:
        """Begin again with no term where there are too many; ``round`` tells."""
        if self.full():
            self.round += 1
            self.terms, self.names = {}, []

    def number(self, name: str) -> int:
        known = self.terms.get(name)
        if known is None:
            known = self.terms[name] = len(self.terms)
            self.names.append(name)
        return known

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of all words, word by word, and how many each has. As ``word_ngrams``: a padded word no longer than n is
        given once and ends that word. An n-gram is first a number in the base of the words' own alphabet, so that only
        different ones are looked up."""
        padded = [f" {w} " for w in words]
        text, lengths = "".join(padded), np.fromiter(map(len, padded), np.int64, len(padded))
        alphabet, mark = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
        base = len(alphabet) + 1
        if self.low > 3 or base ** self.high >= 1 << 62:
            known = [[self.number(w[at:at + n]) for n in range(self.low, max(self.low, min(self.high, len(w))) + 1)
                      for at in range(max(1, len(w) - n + 1))] for w in padded]
            return np.array([n for k in known for n in k], np.int64), np.array([len(k) for k in known])
        word = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))
        code, found = np.zeros(len(text), np.int64), []
        for n in range(1, self.high + 1):
            code = code[:len(text) - n + 1] * base + mark[n - 1:] + 1
            if n >= self.low:
                at = np.flatnonzero(left[:len(code)] >= n)
                found.append((code[at], at, np.full(len(at), n)))
        codes, at, n = (np.concatenate(part) for part in zip(*found))
        _, first, again = np.unique(codes, return_index=True, return_inverse=True)
        numbers = np.array([self.number(text[i:i + m]) for i, m in zip(at[first].tolist(), n[first].tolist())], np.int64)
        return numbers[again][np.argsort(word[at], kind="stable")], np.bincount(word[at], minlength=len(words))

    def counted(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the rows' n-grams, by row, each term of a row once."""
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        if not known:
            return (np.zeros(0, np.int64),) * 3
        flat, sizes = self.cut(known)
        begins = np.cumsum(sizes) - sizes
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        # a word of a row once, with its count, then its terms
        pairs, times = np.unique(np.repeat(np.arange(len(words)), lengths) * len(known) + coded.indices.to_numpy(), return_counts=True)
        row, word = np.divmod(pairs, len(known))
        ends = np.cumsum(sizes[word])
        term = flat[np.arange(ends[-1]) + np.repeat(begins[word] - ends + sizes[word], sizes[word])]
        row, times = np.repeat(row, sizes[word]), np.repeat(times, sizes[word])
        if len(words) <= 1 << 8 and len(self.terms) < 1 << 24 and len(coded) < 1 << 31:  # all in one number: 8, 24 and 31 bits
            shift, packed = 24, np.sort((row << 55) | (term << 31) | times)
            key, times = packed >> 31, packed & 0x7FFFFFFF
        else:
            shift, key = 40, (row << 40) | term
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        places = np.flatnonzero(np.diff(key, prepend=-1))
        return key[places] >> shift, key[places] & ((1 << shift) - 1), np.add.reduceat(times, places)

    def named(self, term: np.ndarray) -> pa.Array:
        """The texts of terms."""
        met = np.zeros(len(self.names), bool)
        met[term] = True
        return pa.array([self.names[i] for i in np.flatnonzero(met)], pa.string()).take(pa.array((np.cumsum(met) - 1)[term]))


def _counted(batches: Iterator[pa.RecordBatch], grams: _Grams) -> Iterator[tuple]:
    """Slices of the batches, by their ``__words``, with the counts of their n-grams."""
    for batch in batches:
        upto = np.cumsum(batch.column("__words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            fitting = np.searchsorted(upto, (upto[start - 1] if start else 0) + WORDS_AT_ONCE, side="right")
            part = batch.slice(start, min(DOCUMENTS_AT_ONCE, max(1, int(fitting) - start)))
            start += part.num_rows
            yield part, *grams.counted(part.column("__words"))
            grams.forget()


#: Bits of a character in a code; characters of rows that are coded together; of codes, those that are not added up yet.
BITS, CHARACTERS, OPEN = 7, 150_000, 500_000


def _coded(words: pa.ListArray, low: int = config.NGRAM_MIN, high: int = config.NGRAM_MAX) -> Iterator[tuple]:
    """Rows by the slice: the slice, the n-grams of its rows as (code, row, count), by code, then row, and which of its rows are left
    out: those with a character beyond ASCII, and those too long to be coded with others.

    A code is the n-gram's characters, 7 bits each, from the left, so codes are ordered as their texts are. An n-gram costs a place in
    a sorted array, whether it was met before or not."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().cast(pa.string())
    begins = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    words_upto = np.append(0, np.cumsum(lengths))
    # as padded: a blank on both sides of a word
    chars_upto = begins[words_upto] + 2 * words_upto
    start = 0
    while start < len(words):
        stop = max(start + 1, min(int(np.searchsorted(chars_upto, chars_upto[start] + CHARACTERS, side="right")) - 1, start + (1 << 16)))
        first, last = words_upto[start], words_upto[stop]
        size, row = np.diff(begins[first:last + 1]), np.repeat(np.arange(stop - start), lengths[start:stop])
        text = data[begins[first]:begins[last]]
        left_out = np.zeros(stop - start, bool)
        if low > 3 or BITS * high > 35 or chars_upto[stop] - chars_upto[start] > CHARACTERS:
            left_out[:] = True
        else:
            strange = np.flatnonzero((text == 0) | (text >= 1 << BITS))
            left_out[row[np.searchsorted(begins[first + 1:last + 1] - begins[first], strange, side="right")]] = True
        if left_out.any():
            kept = ~left_out[row]
            text, size, row = text[np.repeat(kept, size)], size[kept], row[kept]
        padded = size + 2
        chars, ends = np.full(int(padded.sum()), ord(" "), np.int64), np.cumsum(padded)
        chars[np.arange(len(text)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = text
        left, row = np.repeat(ends, padded) - np.arange(len(chars)), np.repeat(row, padded)
        code, keys = chars << BITS * (high - 1), []
        for n in range(1, high + 1):
            if n > 1:
                code = code[:len(chars) - n + 1] | chars[n - 1:] << BITS * (high - n)
            if n >= low:
                at = left[:len(code)] >= n
                keys.append(code[at] << 28 | row[:len(code)][at])
        keys = np.sort(np.concatenate(keys))
        places = np.flatnonzero(np.diff(keys, prepend=-1))
        pairs = keys[places]
        yield words.slice(start, stop - start), pairs >> 28, pairs & ((1 << 28) - 1), np.diff(places, append=len(keys)), left_out
        start = stop


def _only(words: pa.ListArray, kept: np.ndarray) -> list[pa.RecordBatch]:
    """Some rows as a batch, if there are any."""
    return [pa.RecordBatch.from_arrays([words.filter(pa.array(kept))], names=["__words"])] if kept.any() else []


def _texts(codes: np.ndarray, high: int = config.NGRAM_MAX) -> pa.Array:
    """The texts of codes."""
    chars = ((codes[:, None] >> (BITS * np.arange(high - 1, -1, -1))) & ((1 << BITS) - 1)).astype(np.uint8)
    offsets = np.append(0, np.cumsum((chars > 0).sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars[chars > 0].tobytes()))


def _codes_of(texts: list[str], high: int = config.NGRAM_MAX) -> np.ndarray:
    """The codes of texts; -1 for a text that has none."""
    found = np.full(len(texts), -1, np.int64)
    for i, text in enumerate(texts):
        raw = text.encode()
        if len(raw) <= high and all(0 < c < 1 << BITS for c in raw):
            found[i] = sum(c << BITS * (high - 1 - k) for k, c in enumerate(raw))
    return found


class _Totals:
    """Document frequencies and totals by code."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.known = 0

    def add(self, code: np.ndarray, count: np.ndarray) -> None:
        """``count`` of a document's n-gram ``code``; codes in order."""
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if len(first):
            self.parts.append((code[first], np.diff(first, append=len(code)), np.add.reduceat(count, first)))
            if sum(len(p[0]) for p in self.parts) > self.known + OPEN:
                self.merge()

    def merge(self) -> None:
        code, df, total = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        self.parts, self.known = [(code[first], np.add.reduceat(df[order], first), np.add.reduceat(total[order], first))], len(first)

    def told(self) -> pa.RecordBatch:
        """All of them; none is remembered."""
        self.merge()
        (code, df, total), self.parts, self.known = self.parts[0], [], 0
        return pa.RecordBatch.from_arrays([_texts(code), pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """``values``, which are in the order of ``row``, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def term_lists(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, terms, counts)``: a row for each document that has a word, with its distinct terms and how often each occurs.
    A document's terms are counted where the document is, no shuffle; a word's n-grams are made once a task."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for part, row, term, count in _counted(batches, grams):
            yield pa.RecordBatch.from_arrays([part.column(doc_id), _lists(row, part.num_rows, grams.named(term)), _lists(
                row, part.num_rows, pa.array(count, pa.int32()))], names=schema.names)

    return docs.select(doc_id, words(F.col(text)).alias("__words")).mapInArrow(run, schema).where(F.size("terms") > 0)


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, term, count)``: ``term_lists`` in long form."""
    return term_lists(docs, doc_id, text).select(doc_id, F.inline(F.arrays_zip("terms", "counts"))).toDF(doc_id, "term", "count")


def tfidf_vocab(docs: DataFrame, text: str, min_df: int = config.MIN_DOCUMENT_FREQUENCY,
                max_features: int = config.VOCABULARY_SIZE, doc_id: str = "doc_id") -> DataFrame:
    """``(term, df, total, idf, index)``: terms of at least ``min_df`` documents, the
    ``max_features`` most frequent of them (equal counts by term), smoothed idf, and
    the position in term order.

    Corpus counts and document frequencies are counted in one pass, a document within its
    row, added up within a task, and only then shuffled by term.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, total, totals = _Grams(), np.zeros(0, np.int64), np.zeros(0, np.int64), _Totals()

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams.names, pa.string()), pa.array(df), pa.array(total)], names=["term", "df", "total"])

        for batch in batches:
            for part, code, _, coded_count, left_out in _coded(batch.column("__words")):
                totals.add(code, coded_count)
                if totals.known > TERMS:
                    yield totals.told()
                for _, _, term, count in _counted(_only(part, left_out), grams):
                    size = len(grams.names)
                    df = np.bincount(term, minlength=size) + np.concatenate([df, np.zeros(size - len(df), np.int64)])
                    total = np.bincount(term, count, minlength=size).astype(np.int64) + np.concatenate([total, np.zeros(size - len(total), np.int64)])
                    if grams.full():  # its terms are forgotten next
                        yield found()
                        df = total = np.zeros(0, np.int64)
        if len(df):
            yield found()
        if totals.parts:
            yield totals.told()

    counted = docs.select(words(F.col(text)).alias("__words")).mapInArrow(run, "term string, df bigint, total bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total").alias("total")).filter(F.col("df") >= min_df)

    top = counted.orderBy(F.col("total").desc(), "term").limit(max_features)
    n = docs.agg(F.count("*")).scalar()
    # at most max_features rows, collected into one array to number them by term
    numbered = top.agg(F.sort_array(F.collect_list(F.struct("term", "df", "total"))).alias("v"))
    return numbered.select(F.posexplode("v").alias("index", "t")).select(
        "t.*", "index").withColumn("idf", F.ln((n + 1) / (F.col("df") + 1)) + 1.0)


def weight_lists(docs: DataFrame, doc_id: str, text: str, vocab: list[tuple[str, float]]) -> DataFrame:
    """``(doc_id, indices, weights)``: for each document that has a term of ``vocab`` (term and idf, by index) the terms' indices
    and ``(1 + ln count) * idf`` at unit length."""
    index = docs.sparkSession.sparkContext.broadcast(({term: i for i, (term, _) in enumerate(vocab)}, np.array([idf for _, idf in vocab])))
    schema = T.StructType([docs.schema[doc_id], T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term, idf = index.value
        grams, places, of_round = _Grams(), np.zeros(0, np.int64), 0
        for part, row, term, count in _counted(batches, grams):
            if grams.round != of_round:
                places, of_round = places[:0], grams.round
            places = np.concatenate([places, np.array([of_term.get(t, -1) for t in grams.names[len(places):]], np.int64)])
            place = places[term]
            row, place, count = row[place >= 0], place[place >= 0], count[place >= 0]
            weight = (np.log(count) + 1.0) * idf[place]
            length = np.sqrt(np.bincount(row, weight * weight, minlength=part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(doc_id), _lists(row, part.num_rows, pa.array(place, pa.int32())), _lists(
                row, part.num_rows, pa.array(weight / length[row]))], names=schema.names)

    return docs.select(doc_id, words(F.col(text)).alias("__words")).mapInArrow(run, schema).where(F.size("indices") > 0)


def unit_vectors(spark: SparkSession, terms: list[str], idf: np.ndarray) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """From lists of words to sparse vectors of ``(1 + ln count) * idf`` at unit length, by the terms' places in ``terms``, as an Arrow
    function. Counts, weights and length are found in one step; rows whose n-grams are no terms get empty vectors."""
    size, codes = len(terms), _codes_of(terms)
    order = np.argsort(codes, kind="stable")
    order = order[codes[order] >= 0]
    told = spark.sparkContext.broadcast((codes[order], order, {t: i for i, t in enumerate(terms)}, idf))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes, of_code, of_term, idf = told.value
        grams, of_round, places = _Grams(), 0, np.zeros(0, np.int64)
        for batch in batches:
            found = [as_vectors(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, idf)]
            for part, code, row, count, left_out in _coded(batch):
                first = np.flatnonzero(np.diff(code, prepend=-1))
                own = code[first]
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                place = np.where(codes[at] == own, of_code[at], -1) if len(codes) else np.full(len(own), -1)
                place = np.repeat(place, np.diff(first, append=len(code)))
                known = place >= 0
                entries = [((row[known] << 24) | place[known], count[known])]
                begin = np.flatnonzero(left_out)
                for some, row, term, count in _counted(_only(part, left_out), grams):
                    if grams.round != of_round:
                        places, of_round = places[:0], grams.round
                    places = np.concatenate([places, np.array([of_term.get(t, -1) for t in grams.names[len(places):]], np.int64)])
                    place = places[term]
                    known = place >= 0
                    entries.append(((begin[row[known]] << 24) | place[known], count[known]))
                    begin = begin[some.num_rows:]
                found.append(as_vectors(*(np.concatenate(c) for c in zip(*entries)), len(part), idf))
            yield pa.concat_arrays(found)

    def as_vectors(key: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray) -> pa.StructArray:
        if count.max(initial=0) < 1 << 23:  # all in one number: 16, 24 and 23 bits
            packed = np.sort((key << 23) | count)
            key, count = packed >> 23, packed & ((1 << 23) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
        row, place = key >> 24, key & ((1 << 24) - 1)
        top = count.max(initial=1)
        logs = np.log(np.arange(1, top + 1))[count - 1] if top < 1 << 12 else np.log(count)
        weight = (logs + 1.0) * idf[place]
        length = np.sqrt(np.bincount(row, weight * weight, minlength=rows))
        return pa.StructArray.from_arrays([
            pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)), _lists(row, rows, pa.array(place, pa.int32())),
            _lists(row, rows, pa.array(weight / length[row]))], names=["type", "size", "indices", "values"])

    return run
