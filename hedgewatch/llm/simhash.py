"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most d bits apart agree in at least 8 - d of their 8 bytes, so they share a posting of every
family of position sets that meets each choice of 8 - d positions. Postings are keyed by the bytes at such a set; the pairs
within one are tallied (how many positional bytes agree), kept at 8 - d or more, and verified bit by bit. A posting
yields a spanning forest of its links, not its pairs, and large postings are split in blocks that meet in pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch.llm.common import components, quoted, slices_of_texts, texts_of
from hedgewatch.session import cut_lineage

#: Distance of fingerprints that link, words of a shingle, seed of the shingle hash.
MAX_BITS, WORDS, SEED = 4, 4, 42
#: Rows of a posting that meet in one go; a larger posting is split in blocks of so many.
BLOCK = 2048
_LOWER = {c: c + 32 for c in range(65, 91)}
_BLANKS = re.compile("[\x20\x09-\x0d]+")


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words of the lower-cased text, in order; of all words where there are fewer."""
    joined = _BLANKS.sub(" ", text.translate(_LOWER)).strip(" ").encode()
    if not joined:
        return []
    digest = xxhash.xxh64_intdigest
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(cuts) < words:
        return [digest(joined, SEED)]
    starts = np.concatenate(([0], cuts[:len(cuts) - words + 1] + 1)).tolist()
    ends = np.concatenate((cuts[words - 1:], [len(joined)])).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def fingerprint_of(hashes: list[int]) -> int:
    """Bit i is set if over half the hashes have it."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[begin:begin + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long): one row a document; null and empty texts and texts of blanks give zero."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for begin, end in slices_of_texts(texts):
                own = np.array([fingerprint_of(shingle_hashes(t)) for t in texts[begin:end]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(own)],
                                                 names=["doc_id", "fingerprint"])

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint bigint")


def position_sets(size: int, agreeing: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the 8 byte positions such that every ``agreeing`` positions contain one: a greedy cover."""
    open_ = [frozenset(c) for c in combinations(range(8), agreeing)]
    sets = []
    while open_:
        best = max(combinations(range(8), size), key=lambda s: sum(c.issuperset(s) for c in open_))
        sets.append(best)
        open_ = [c for c in open_ if not c.issuperset(best)]
    return sets


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a long, b long) whose components are those of all pairs of distinct ``fingerprint`` values at most
    ``max_bits`` (0 to 7) apart. Values must be distinct and not null.

    The more values, the more bytes key a posting (2 for up to a few million, then 3, then 4), so a posting of
    random values stays short; results do not depend on it.
    """
    agreeing = 8 - max_bits
    rows = prints.count()
    size = min(agreeing, 1 if rows < 1 << 8 else 2 if rows < 1 << 22 else 3 if rows < 1 << 30 else 4)
    sets = position_sets(size, agreeing)
    at = [f"(shiftleft({n}L, 32) | " + " | ".join(f"shiftleft(shiftrightunsigned(fingerprint, {8 * p}) & 255L, {8 * i})" for i, p in enumerate(s)) + ")"
          for n, s in enumerate(sets)]
    if size == 4:  # the set's number would meet the fourth byte's sign: keep it apart
        at = [f"xxhash64({n}, {e})" for n, e in enumerate(at)]
    postings = prints.select("fingerprint", F.explode(F.expr(f"array({', '.join(at)})")).alias("posting"))
    sizes = postings.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = postings.join(sizes, "posting").withColumn("blocks", F.expr(f"CAST(ceil(n / {block}) AS INT)"))
    own = F.expr("CAST(pmod(xxhash64(fingerprint, posting), blocks) AS INT)")
    # Block i meets block j in the group (posting, i, j) with i <= j; a row goes to the groups of its block.
    dealt = split.withColumn("own", own).select(
        "posting", "fingerprint", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).selectExpr(
        "posting", "least(own, other) AS i", "greatest(own, other) AS j", "fingerprint", "own")
    groups = dealt.groupBy("posting", "i", "j").agg(F.collect_list("fingerprint").alias("values"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy())
            found, begin = [], 0
            for n in offsets:
                found.append(forest(flat[begin:begin + n], max_bits))
                begin += n
            both = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k].view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return groups.select("values").mapInArrow(meet, "a bigint, b bigint")


def forest(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (rows of two values) that join the components of ``values`` at ``max_bits`` or fewer differing bits.

    A value that is found takes along all values near it: every value is compared once with those not yet found.
    """
    values = np.ascontiguousarray(values)
    rest, out = np.arange(len(values)), []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            seed = stack.pop()
            differing = values[rest] ^ values[seed]
            agreeing = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = np.flatnonzero(agreeing >= 8 - max_bits)
            near = near[np.bitwise_count(differing[near]) <= max_bits]
            if len(near):
                reached = rest[near]
                out.append(np.stack((np.full(len(near), values[seed]), values[reached]), axis=1))
                stack += reached.tolist()
                rest = np.delete(rest, near)
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents linked at ``max_bits`` or fewer differing bits, transitively.

    component_id is the smallest doc_id reachable. Equal fingerprints are one class, whatever their number, and only
    classes are compared. Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows come
    back as often; rows without doc_id take part with the id of their class's smallest, or null if it has none.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fingerprint"), max_bits))
    member = cut_lineage(classes.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")))
    # Written, so that the join deals both sides anew and the optimizer may split a component with very many classes.
    least = cut_lineage(member.groupBy("component").agg(F.min("least").alias("component_id")))
    named = member.join(least, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
