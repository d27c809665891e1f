"""Secret scans: base patterns, and novelty under dictionary-primed zstandard.

The base patterns find assignments, access keys and long hex strings. Beyond them, strings in a sensitive context are
measured: how many bytes does the compressed size of (dictionary of code identifiers, surrounding text) grow if the
string is put in its place? What has been seen around it or is built of known identifiers costs next to nothing; what stays near its full
length is random, and reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hedgewatch.llm.common import quoted, texts_of

# The base patterns and least lengths.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: What may be a secret: a run of these characters with a letter; of name=value the value, where it is long enough.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_CANDIDATE = 16
VALUE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Words that make a context sensitive, looked for so many characters before and after a candidate.
SENSITIVE = re.compile(r"(?i:passw|secret|token|key|auth|credential|private|bearer|session|signature|salt|access|login)", re.ASCII)
NEAR = 48
#: Characters around a candidate that prime the measure.
AROUND = 512
#: Compressed bytes per byte from which a string counts as novel. A short random string costs about its length.
LEAST_NOVELTY = 0.75
#: Stands before all surroundings: very short ones would be stored as they are, and with them every addition.
LEAD = "def handle(request): return session.query(User).filter(name == value)  # loads 17 keys from config, or 204 if none\n" * 2
_PREFIXES = "get set is has on to new old max min num user file data item list map key value name path node type time date".split()
_SUFFIXES = ("Id Name Key Value Token Secret Password Path File Url Host Port Count Index Size Type Time Date List Map "
             "Config Options Request Response Handler Manager Factory Service Client Server Session Context Builder").split()
_WORDS = ("the and for with from that this not have are was which import return function class public private static const "
          "void string integer boolean true false null none self def async await export default require module https http "
          "www com org example localhost application json content-type authorization bearer basic username password "
          "api_key access_key secret_key client_id client_secret 0123456789 abcdefghijklmnopqrstuvwxyz "
          "ABCDEFGHIJKLMNOPQRSTUVWXYZ").split()


def identifier_dictionary() -> bytes:
    """Identifiers and code words, by rule from the lists above: a raw-content dictionary, most telling parts last."""
    camel = [p + s for p in _PREFIXES for s in _SUFFIXES]
    snake = [f"{p}_{s.lower()}" for p in _PREFIXES for s in _SUFFIXES]
    return " ".join([*snake, *camel, *_WORDS]).encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind as listed; whole matches, leftmost, not overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self):
        data = zstandard.ZstdCompressionDict(identifier_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            19, window_log=17, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressor = zstandard.ZstdCompressor(dict_data=data, compression_params=how)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to its surroundings, per byte."""
        own = text[start:end]
        # Its own copies say nothing about whether it is known: a secret may stand twice.
        before, after = LEAD + text[max(0, start - AROUND):start].replace(own, ""), text[end:end + AROUND].replace(own, "")
        return max(0, self.size(before + after + own) - self.size(before + after)) / max(1, end - start)


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what is measured: long values of name=value (padding stays with its value), else the whole run; of
    either, what lies outside the base spans."""
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        values = [(x, y) for x, y in (v.span() for v in VALUE.finditer(text, a, b)) if y - x >= LEAST_CANDIDATE] if "=" in m[0] else []
        for begin, end in values or [(a, b)]:
            for x, y in [*((x, y) for x, y, _ in base if x < end and begin < y), (end, end)]:  # by start
                if x - begin >= LEAST_CANDIDATE:
                    yield begin, x
                begin = max(begin, y)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context (a name directly before the value counts) that stay incompressible."""
    found = []
    for a, b in candidates(text, base):
        if SENSITIVE.search(text, max(0, a - NEAR), a) or SENSITIVE.search(text, b, b + NEAR):
            if novelty.of(text, a, b) >= LEAST_NOVELTY:
                found.append((a, b, "novel"))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text.

    Returns (doc_id, base, spans): arrays of (start, end, kind, value), positions in code points, end exclusive, by start and then kind;
    ``base`` holds what the base patterns find, ``spans`` these and the novel strings. Null and empty texts have none; repeated rows
    come back as often; other columns are not looked at. No shuffle; a row depends on its own text alone.
    """
    order = {k: i for i, k in enumerate(KINDS)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            base, every = [], []
            for text in texts_of(batch, "text"):
                own = base_spans(text)
                both = own + novel_spans(text, own, novelty) if SENSITIVE.search(text) else own
                both = sorted(both, key=lambda s: (s[0], order[s[2]])) if len(both) > len(own) else both
                base.append([{"start": a, "end": b, "kind": k, "value": text[a:b]} for a, b, k in own])
                every.append([{"start": a, "end": b, "kind": k, "value": text[a:b]} for a, b, k in both])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, spans), pa.array(every, spans)],
                                             names=["doc_id", "base", "spans"])

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("base", kind), T.StructField("spans", kind)])
    return rows.mapInArrow(find, schema)
