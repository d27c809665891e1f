"""Byte-pair encoding and decoding of whole texts by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round finds the lowest-ranked pair of
every word (binary search of new pairs over sorted pair keys, a segmented minimum), merges all its
occurrences from left to right, and drops words that have no pair left. A merged symbol can only take part in
pairs of higher rank, so merging all occurrences at once equals merging them one by one.

Words repeat, so a task keeps the ids of the pieces between blanks it has met (beyond ``CACHE_PIECES`` it drops those used once).
A blank before a character that is not white space always starts a word of the pattern; texts in which a blank is
followed by white space or the end go through the pattern as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch.llm.common import PieceCache, quoted, ragged_index, slices_of_texts, split_sums, texts_of

#: Fixed value: the word pattern of byte-level vocabularies of this family.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a task remembers; a bound on memory, not on results.
CACHE_PIECES = 500_000
#: Words that go through the rounds together: their arrays stay in a core's cache.
WORDS_AT_ONCE = 16_384
NO_RANK = np.iinfo(np.int32).max
#: Signs that form one word of the pattern behind letters (no apostrophe: it may open a word with letters).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Vocabulary:
    """A vocabulary file as arrays: fit to be sent to tasks."""

    byte_ids: np.ndarray        # id of each of the 256 bytes, then of each as the last of its word
    byte_pair_ranks: np.ndarray  # at first byte * 256 + second byte, then where the second ends the word
    byte_pair_ids: np.ndarray
    pair_keys: np.ndarray       # left id * size + right id, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray        # what the pair becomes
    token_bytes: np.ndarray     # all tokens' bytes
    token_starts: np.ndarray
    token_lengths: np.ndarray
    special: dict[str, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.token_lengths)


def printable_bytes() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library. Files with a normalizer, a prefix blank or added tokens
    that strip or match by word raise ``ValueError``: their ids would differ."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, pre = content["model"], content.get("pre_tokenizer") or {}
    if (content.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or model.get("end_of_word_suffix")):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    return model_vocabulary(content)


def model_vocabulary(content: dict) -> Vocabulary:
    """The merges, tokens and added tokens of a vocabulary file's content, whatever comes before the merges."""
    model, added = content["model"], content.get("added_tokens", [])
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or not model["merges"]:
        raise ValueError("not a BPE vocabulary with merges")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that strip or match by word are not supported")
    ids: dict[str, int] = model["vocab"]
    special = {t["content"]: t["id"] for t in added}
    ending = model.get("end_of_word_suffix") or ""
    size = max([*ids.values(), *special.values()]) + 1
    characters = printable_bytes()
    byte_of = {c: b for b, c in enumerate(characters)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    becomes = np.array([ids[a + b] for a, b in merges], np.int32)[order]
    pieces = [b""] * size
    for token, i in ids.items():
        bare = token[:len(token) - len(ending)] if ending and token.endswith(ending) else token
        pieces[i] = bytes(byte_of[c] for c in bare) + b" " * (bare != token)
    for token, i in special.items():
        pieces[i] = token.encode()
    lengths = np.array([len(p) for p in pieces], np.int64)
    byte_ids = np.array([*[ids[c] for c in characters], *[ids[c + ending] for c in characters]], np.int32)
    pairs = (byte_ids[:256].astype(np.int64)[None, :, None] * size + byte_ids.reshape(2, 1, 256)).ravel()
    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    return Vocabulary(
        byte_ids=byte_ids, byte_pair_ranks=np.where(keys[at] == pairs, order[at], NO_RANK).astype(np.int32), byte_pair_ids=becomes[at],
        pair_keys=keys, pair_ranks=order.astype(np.int32), pair_ids=becomes,
        token_bytes=np.frombuffer(b"".join(pieces), np.uint8), token_starts=np.cumsum(lengths) - lengths,
        token_lengths=lengths, special=special)


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each. Words may be empty."""
    blocks = [_encode_block(words[i:i + WORDS_AT_ONCE], vocabulary) for i in range(0, len(words), WORDS_AT_ONCE)]
    if not blocks:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


def _byte_counts(words: list[str], joined: str) -> np.ndarray:
    counts = np.fromiter(map(len, words), np.int64, len(words))
    if joined.isascii():
        return counts
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
    return np.diff(ends)


def _encode_block(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(words)
    flat = np.frombuffer(joined.encode(), np.uint8)
    word = np.repeat(np.arange(len(words), dtype=np.int32), _byte_counts(words, joined))
    last = np.append(word[1:] != word[:-1], np.ones(min(1, len(word)), bool)).astype(np.int32)
    symbols = vocabulary.byte_ids[flat + last * 256]
    out_symbols, out_words = [], []
    # Pairs of single bytes come from a table; all later pairs by binary search.
    couple = flat[:-1].astype(np.int32) << 8 | flat[1:] | last[1:] << 16
    together = word[1:] == word[:-1]
    rank = np.full(len(symbols), NO_RANK, np.int32)
    becomes = np.zeros(len(symbols), np.int32)
    rank[:-1] = np.where(together, vocabulary.byte_pair_ranks[couple], NO_RANK)
    becomes[:-1] = vocabulary.byte_pair_ids[couple]
    keys_known = vocabulary.pair_keys
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(first, len(word)))
        lowest = np.minimum.reduceat(rank, first)
        going = lowest < NO_RANK
        if not going.all():
            open_ = np.repeat(going, size)
            out_symbols.append(symbols[~open_])
            out_words.append(word[~open_])
            symbols, word, rank, becomes = symbols[open_], word[open_], rank[open_], becomes[open_]
            size, lowest = size[going], lowest[going]
            if not len(symbols):
                break
        chosen = np.flatnonzero(rank == np.repeat(lowest, size))
        # Of pairs that overlap (a run of one symbol) every second is merged, from the left.
        fresh = np.concatenate(([True], np.diff(chosen) != 1))
        if not fresh.all():
            run = np.cumsum(fresh) - 1
            chosen = chosen[(np.arange(len(chosen)) - np.flatnonzero(fresh)[run]) % 2 == 0]
        symbols[chosen] = becomes[chosen]
        kept = np.ones(len(symbols), bool)
        kept[chosen + 1] = False
        symbols, word, rank, becomes = symbols[kept], word[kept], rank[kept], becomes[kept]
        at = chosen - np.arange(len(chosen))  # each merge before a position moved it by one
        touched = np.zeros(len(symbols), bool)
        touched[at] = touched[np.maximum(at - 1, 0)] = True
        touched = np.flatnonzero(touched)
        rank[touched] = NO_RANK
        inside = touched[touched + 1 < len(symbols)]
        inside = inside[word[inside] == word[inside + 1]]
        keys = symbols[inside].astype(np.int64) * vocabulary.size + symbols[inside + 1]
        found = np.minimum(np.searchsorted(keys_known, keys), len(keys_known) - 1)
        rank[inside] = np.where(keys_known[found] == keys, vocabulary.pair_ranks[found], NO_RANK)
        becomes[inside] = vocabulary.pair_ids[found]
    if not out_symbols:
        return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
    symbols, word = np.concatenate(out_symbols), np.concatenate(out_words)
    # A word's symbols leave together and in order; put the words back in order.
    order = np.argsort(word, kind="stable")
    return symbols[order].astype(np.uint32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes lists of texts; remembers the pieces it has met.

    A piece is keyed by its type: a string is what follows a blank, a tuple is what
    opens a text, bytes are one word of the pattern, an int is an added token.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(WORD_PATTERN)
        self.loose = re.compile(r" (?=\s|\Z)")
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cache = PieceCache(CACHE_PIECES)

    def pieces(self, text: str) -> list:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [p for i, part in enumerate(parts) for p in ([self.vocabulary.special[part]] if i % 2 else self.words(part))]
        if self.loose.search(text):
            return self.words(text)
        pieces: list = text.split(" ")
        pieces[0] = (pieces[0],)
        return pieces

    def words(self, text: str) -> list[bytes]:
        return [w.encode() for w in self.pattern.findall(text)]

    def learn(self, missing: list) -> tuple[np.ndarray, np.ndarray]:
        words, per_piece = [], []
        for piece in missing:
            if type(piece) is str:
                letters = piece.rstrip(SIGNS)
                if not letters.isalpha():
                    own = self.pattern.findall(" " + piece)
                    words += own
                    per_piece.append(len(own))
                elif len(letters) == len(piece):
                    words.append(" " + piece)
                    per_piece.append(1)
                else:
                    words += (" " + letters, piece[len(letters):])
                    per_piece.append(2)
            else:
                own = [piece.decode()] if type(piece) is bytes else [] if type(piece) is int else self.pattern.findall(piece[0])
                words += own
                per_piece.append(len(own))
        ids, counts = encode_words(words, self.vocabulary)
        lengths = split_sums(counts, per_piece)
        for i in [i for i, piece in enumerate(missing) if type(piece) is int]:  # an added token is its own id
            ids = np.insert(ids, lengths[:i].sum(), missing[i])
            lengths[i] = 1
        return ids, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and the number of ids of each."""
        lists = [self.pieces(t) for t in texts]
        ids, lengths = self.cache.look_up(list(chain.from_iterable(lists)), self.learn)
        return ids, split_sums(lengths, [len(p) for p in lists])


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """Bytes of the tokens, one after another. An id the vocabulary lacks gives no bytes."""
    ids = ids[ids < vocabulary.size].astype(np.int64)
    return vocabulary.token_bytes[ragged_index(vocabulary.token_starts[ids], vocabulary.token_lengths[ids])].tobytes()


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                     decoded: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Returns (doc_id, n_tokens long, ids binary: little-endian unsigned 32-bit), and with ``decoded`` also the text
    that those ids give. Null and empty texts have no ids and decode to the empty text; a null id stays null; repeated
    rows are encoded as often as they come; other columns of ``docs`` are not looked at. No shuffle.
    """
    context = docs.sparkSession.sparkContext
    # As large as the vocabulary, whatever the input. Plain arrays: a broadcast names classes, and executors have no copy of this package.
    shared = context.broadcast(vars(load_vocabulary(vocabulary_path)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shared.value))
        for batch in batches:
            texts = texts_of(batch, "text")
            for begin, end in slices_of_texts(texts):
                ids, counts = encoder.encode(texts[begin:end])
                ends = np.cumsum(counts)
                each = [ids[b - n:b] for b, n in zip(ends, counts, strict=True)]
                arrays = [batch.column("doc_id").slice(begin, end - begin), pa.array(counts, pa.int64()),
                          pa.array([i.tobytes() for i in each], pa.binary())]
                if decoded:
                    arrays.append(pa.array([decode_ids(i, encoder.vocabulary).decode("utf-8", "replace") for i in each], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary"
    schema += ", decoded string" if decoded else ""
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded
    return rows.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids binary). Null ids decode to the empty text; bytes that are not UTF-8 become
    the replacement character."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(load_vocabulary(vocabulary_path)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**shared.value)
        for batch in batches:
            texts = [decode_ids(np.frombuffer(i or b"", "<u4"), vocabulary).decode("utf-8", "replace")
                     for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Ids and round trip of every document as digests."""
    return encode_documents(docs, vocabulary_path, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
