"""Best-fit packing by minimum bin slack.

Each sequence takes the longest piece left and the fullest feasible combination of the others, found by
subset sums over the available lengths as bits of one integer. What matters is only how many pieces have which length: at
most ``capacity`` counts, whatever the input. A combination is repeated as long as its pieces last, so the number of
combinations also depends on the capacity alone. Pieces find their place from their rank among pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch.llm.bpe import SIGNS, encode_words, model_vocabulary
from hedgewatch.llm.common import PieceCache, quoted, rank_within, slices_of_texts, split_sums, texts_of
from hedgewatch.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Pieces between blanks a task remembers; a bound on memory, not on results.
CACHE_PIECES = 300_000
#: Characters of text cut into pieces at a time.
CHARS_AT_ONCE = 1_000_000


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as token ids plus ``end_id``, cut only where longer than ``capacity``.

    Returns (doc_id, piece, start, length, ids_crc32): one row a piece; a null or empty text has one piece of one id.
    Ids are those of the tokenizers library for a vocabulary that drops white space, so parts between blanks are
    encoded once per task and remembered. Repeated rows give repeated pieces; other columns are not looked at.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = RememberedIds(shared.value)
        for batch in batches:
            texts, owners = texts_of(batch, "text"), batch.column("doc_id")
            for begin, end in slices_of_texts(texts, CHARS_AT_ONCE):
                rows = []
                for i, ids in enumerate(remembered.encode(texts[begin:end]), begin):
                    ids = np.append(ids, np.uint32(end_id))
                    rows += [(i, p, s, len(part := ids[s:s + capacity]), zlib.crc32(part.astype("<u4").tobytes()))
                             for p, s in enumerate(range(0, len(ids), capacity))]
                i, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [owners.take(pa.array(i, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, "
                                "length bigint, ids_crc32 bigint")


class RememberedIds:
    """Ids of texts as the tokenizers library gives them, found once for each part between blanks
    and line ends.

    Nearly all parts are letters below U+0250 with or without a tail of signs: the vocabulary's word pattern takes these for one word or two,
    and the batched merge rounds of ``bpe`` give their ids. All other parts go to the library itself.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        content = json.loads(vocabulary)
        if [n["type"] for n in content["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary that lower-cases and drops white space")
        self.vocabulary = model_vocabulary(content)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = PieceCache(CACHE_PIECES)

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, counts, other = [], np.zeros(len(pieces), np.int64), []
        for i, piece in enumerate(pieces):
            letters = piece.rstrip(SIGNS)
            lower = letters.lower()
            # An added token may stand after "<"; the lower case of some letters is not letters alone.
            if not (lower.isalpha() and (lower.isascii() or max(lower) < "\u0250")) or "<" in piece:
                other.append(i)
            elif len(letters) == len(piece):
                words.append(lower)
                counts[i] = 1
            else:
                words += (lower, piece[len(letters):])
                counts[i] = 2
        ids, lengths = encode_words(words, self.vocabulary)
        lengths = split_sums(lengths, counts)
        if other:
            lists = [self.tokenizer.encode(pieces[i], add_special_tokens=False).ids for i in other]
            lengths[other] = [len(i) for i in lists]
            where = np.repeat(counts > 0, lengths)
            every = np.zeros(len(where), np.uint32)
            every[where], every[~where] = ids, list(chain.from_iterable(lists))
            ids = every
        return ids, lengths

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        ids, lengths = self.pieces.look_up(list(chain.from_iterable(lists)), self.learn)
        begin = 0
        for n in split_sums(lengths, [len(p) for p in lists]):
            yield ids[begin:begin + n]
            begin += n


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The combination of (length, count) that fills most of ``room``, as (length, used).

    Bit s of ``reach`` is set if the lengths so far can sum to s. A length of which there are many goes in as packs of
    1, 2, 4, ...; the search ends when the room can be filled exactly.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length, count in available:
        left, pack = min(count, room // length), 1
        while left > 0:
            taken = min(pack, left)
            trail.append((length, taken, reach))
            reach |= (reach << (taken * length)) & mask
            left -= taken
            pack *= 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, taken, before in reversed(trail):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + taken
            best -= taken * length
    return list(used.items())


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, used), ...]) that use up ``counts`` ({length: pieces})."""
    left, found = dict(sorted(counts.items(), reverse=True)), []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        rest = [(n, c - (n == longest)) for n, c in left.items() if n <= room]
        used = {longest: 1}
        for n, c in fullest(rest, room):
            used[n] = used.get(n, 0) + c
        times = min(left[n] // c for n, c in used.items())
        found.append((times, list(used.items())))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return found


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per combination and length: the first rank it takes, and how a rank there becomes a sequence and an offset."""
    rows, taken, sequence = [], {}, 0
    for times, used in found:
        offset = 0
        for n, c in used:
            rows.append((n, taken.get(n, 0), sequence, c, offset))
            taken[n] = taken.get(n, 0) + times * c
            offset += n * c
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "used", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length, ...) of 1 to ``capacity`` tokens.

    Pieces of a sequence lie one after another from 0 and end at ``capacity`` at most. A piece outside those lengths
    raises. Which of two pieces of one length comes first doesn't matter to the packing; a hash decides. Empty in, empty out.
    """
    pieces = cut_lineage(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().limit(capacity + 2).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    table = pieces.sparkSession.sparkContext.broadcast(places(combinations(counts, capacity)))
    ranked = rank_within(pieces, ["length"], ["ids_crc32", "doc_id", "piece"], ["doc_id", "piece", "ids_crc32"], "_rank",
                         rows=sum(counts.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        keys = known["length"] << 48 | known["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            behind = rank - known["rank"][at]
            used = known["used"][at]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(known["sequence"][at] + behind // used), pa.array(known["offset"][at] + behind % used * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.select(*map(quoted, [*names, "_rank"])).mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(token_pieces(docs, vocabulary_path, capacity, end_id), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))
