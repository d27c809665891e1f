"""Personal data: entities replaced by keyed surrogates that keep type, gender, script and format.

Entities are found by pattern, reduced to a canonical form (so that spellings of one entity share a surrogate), and counted once
over all documents. Every distinct entity proposes a surrogate drawn from a keyed hash; proposals that meet
another's, or an entity that occurs, are drawn again until none do. Only documents with entities are joined with the
result; clean documents pass as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch.llm.common import quoted, unused
from hedgewatch.session import cut_lineage

#: Key of the draws where the caller gives none; whoever publishes results passes a secret one.
KEY = "surrogates"
#: Draws of one entity before giving up: a type whose surrogates are nearly used up would need more.
MAX_DRAWS = 64
#: Texts that a task holds as Python strings at a time.
TEXTS_AT_ONCE = 256
TYPES = ("email", "card", "iban", "ssn", "phone", "ip", "name")
# Honorifics by gender.
MALE = "Mr Herr Monsieur Señor Sr Signor Lord Sir Господин".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Signora Lady Госпожа".split()
NEUTRAL = "Dr Prof Professor Mx Доктор".split()
_TITLES = re.compile("|".join(t for w in MALE + FEMALE + NEUTRAL for t in (w, w.upper())))
# Words that begin a line after a honorific or name without being one, and are no later mention of a name.
OTHERS = ("A An And As At But By Dear Do For From He Her His How I If In Is It My No Not Of On Or Our Please Re She So Thank Thanks That The Their "
          "There These They This Those To We When Where Who With Yes You Your Der Die Das Ein Eine Er Es Ich Im Ist Sie Und Wir Le La Les Un Une Et Il "
          "Elle Je Nous Vous El Los Las Una Yo Y Но Не На Он Она Они Мы Вы Это Как По").split()
_LETTERS = [chr(c) for c in (*range(0x41, 0x250), *range(0x400, 0x530), *range(0x1E00, 0x1F00))]
_U = "".join(c for c in _LETTERS if unicodedata.category(c) in ("Lu", "Lt"))
_L = "".join(c for c in _LETTERS if unicodedata.category(c) == "Ll") + "̀-ͯ"
_BLANK = r"[^\S\r\n]"
_LINE = rf"{_BLANK}*\r?\n{_BLANK}*(?!(?:{'|'.join(OTHERS)})\b)"
#: O'Brien, McDonald, SMITH, Jean-Pierre; 's is none of it.
_SIMPLE = rf"[{_U}](?:['’][{_U}](?=[{_U}{_L}])|[{_U}{_L}])+"
_SPELLED = rf"{_SIMPLE}(?:-{_SIMPLE})*"
# Herr Dr. Schmidt: a honorific before a name is no name.
_WORD = rf"(?!(?:{_TITLES.pattern})\b\.?{_BLANK}*[{_U}]){_SPELLED}"
_INITIAL = rf"(?:[{_U}]\.(?:{_BLANK}+|{_LINE})?|[{_U}]{_BLANK}+)"
_PART = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_À-ɏ.+-]*[A-Za-z0-9_À-ɏ+-]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w-]|\.[0-9])|(?<![\w+])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?![\w-]|\.[0-9])",
    "ip": rf"(?<![\w.])(?:{_PART}\.){{3}}{_PART}(?![\w]|\.[0-9])",
}
# An address of parts with three digits looks like a phone number and more: it is tried first.
_ANY = re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in ("email", "iban", "ssn", "ip", "phone", "card")))
_NAME = re.compile(rf"\b(?P<title>{_TITLES.pattern})\b(?:\.?{_BLANK}+|\.?{_LINE}|\.)(?P<words>{_INITIAL}*(?:{_WORD}{_LINE}{_WORD}|"
                   rf"{_WORD}(?:{_BLANK}+{_INITIAL}*{_WORD}){{0,2}}))")
_TOKEN = re.compile(rf"{_SPELLED}|[{_U}]")
_BARE = re.compile(rf"(?<!\w){_SPELLED}(?!\w)")
_SINGLE = re.compile(_SIMPLE)
_TURNED = {w.lower() for w in OTHERS}
_GENDER = {t: g for g, words in (("n", NEUTRAL), ("f", FEMALE), ("m", MALE)) for w in words for t in (w, w.upper())}
_MAY = re.compile(r"@|[0-9][0-9.\x20()-]{5}|[A-Z]{2}[0-9]{2}")
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvw"
_RU_VOWELS, _RU_CONSONANTS = "аеиоу", "бвгдзклмнпрст"


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _plain(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower().replace("’", "'")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical) by start, not overlapping; positions in code points.

    Canonical: e-mail in lower case, digits alone for numbers, a name's single word with gender and script. A number is a card if its check
    digit holds or it has 16 digits and a card's first digit; an address has parts up to 255. Words of a name that a honorific
    shows are found wherever else they stand in the text, as the family name if they are one somewhere; initials only beside a name.
    """
    found = []
    if _MAY.search(text):
        for m in _ANY.finditer(text):
            kind, value = m.lastgroup, m[0]
            digits = "".join(c for c in value if c.isdigit())
            if kind == "email":
                found.append((m.start(), m.end(), kind, value.lower()))
            elif kind == "iban":
                found.append((m.start(), m.end(), kind, value.replace(" ", "")))
            elif kind == "ip":
                found.append((m.start(), m.end(), kind, value))
            elif kind == "card":
                if luhn(digits) or (len(digits) == 16 and digits[0] in "3456"):
                    found.append((m.start(), m.end(), kind, digits))
            elif 7 <= len(digits) <= 15 or kind == "ssn":
                found.append((m.start(), m.end(), kind, digits))
    if _TITLES.search(text):
        taken = [(a, b) for a, b, _, _ in found]
        free = lambda a, b: not any(x < b and a < y for x, y in taken)
        known: dict[str, str] = {}
        for m in _NAME.finditer(text):
            gender = _GENDER[m["title"]]
            words = list(_TOKEN.finditer(text, m.start("words"), m.end("words")))
            for i, w in enumerate(words):
                a, b = w.span()
                if free(a, b):
                    script = "cyrillic" if "Ѐ" <= w[0][0] <= "ӿ" else "latin"
                    place = "family" if i == len(words) - 1 else "given"
                    # A family name is one entity whatever title stands before it, unless its form shows gender.
                    own = gender if place == "given" or script == "cyrillic" else "n"
                    word = _plain(w[0])
                    found.append((a, b, "name", f"{script}:{place}:{own}:{word}"))
                    if len(word) > 1 and word not in _TURNED and (word not in known or place == "family" and ":given:" in known[word]):
                        known[word] = found[-1][3]
        if known:
            starts = {a for a, _, kind, _ in found if kind == "name"}
            for m in _BARE.finditer(text):
                whole = _plain(m[0]) in known
                for w in [m] if whole else _SINGLE.finditer(text, *m.span()):
                    a, b = w.span()
                    if _plain(w[0]) in known and a not in starts and m.start() not in starts and free(a, b):
                        found.append((a, b, "name", known[_plain(w[0])]))
    return sorted(found)


class Draw:
    """A stream of numbers from a keyed hash of an entity and the number of the draw."""

    def __init__(self, key: str, kind: str, canonical: str, turn: int):
        self.seed = hmac.new(key.encode(), f"{kind}\0{turn}\0{canonical}".encode(), hashlib.sha256).digest()
        self.left, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % n

    def of(self, characters: str) -> str:
        return characters[self.below(len(characters))]


def check_digits(country: str, body: str) -> str:
    """The two digits that make an account number of a country leave 1 when divided by 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def surrogate(kind: str, canonical: str, turn: int, key: str) -> str:
    """A canonical replacement for a canonical entity: same type, same length where the type has one, valid where it was."""
    draw = Draw(key, kind, canonical, turn)
    digit = lambda: draw.of("0123456789")
    if kind == "email":
        local, _, domain = canonical.partition("@")
        shape = lambda s: "".join(digit() if c.isdigit() else draw.of(_VOWELS if c in _VOWELS else _CONSONANTS) if c.isalpha() else c for c in s)
        # Short names soon run out: a second draw may be longer.
        return f"{shape(local)}{''.join(digit() for _ in range(turn))}@{shape(domain.rpartition('.')[0])}.example"
    if kind == "card":
        body = canonical[0] + "".join(digit() for _ in canonical[2:])
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if luhn(canonical) else digit())
    if kind == "iban":
        body = "".join(digit() if c.isdigit() else draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in canonical[4:])
        valid = check_digits(canonical[:2], canonical[4:]) == canonical[2:4]
        return canonical[:2] + (check_digits(canonical[:2], body) if valid else digit() + digit()) + body
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "phone":
        return canonical[0] + "".join(digit() for _ in canonical[1:])
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    script, place, gender, word = canonical.split(":", 3)
    vowels, consonants = (_RU_VOWELS, _RU_CONSONANTS) if script == "cyrillic" else (_VOWELS, _CONSONANTS)
    stem = "".join(draw.of(consonants) + draw.of(vowels) for _ in range(3 + turn // 4)) + draw.of(consonants)
    if stem[0] == word:  # of an initial, one letter is all that is written
        stem = draw.of(consonants.replace(word, "")) + stem[1:]
    if script == "cyrillic":
        ends = {"family": {"f": "ова", "m": "ов", "n": "ко"}, "given": {"f": "а", "m": "", "n": "и"}}
    else:
        ends = {"family": {"f": "er", "m": "er", "n": "er"}, "given": {"f": "a", "m": "", "n": "i"}}
    return f"{script}:{place}:{gender}:{stem}{ends[place][gender]}"


def shaped(kind: str, value: str, canonical: str) -> str:
    """A canonical surrogate written in the way that ``value`` is: its separators, case and grouping."""
    if kind == "email":
        return canonical.upper() if value.isupper() else canonical
    if kind == "ip":
        return canonical
    if kind == "name":
        word = canonical.rpartition(":")[2]
        if len(value) == 1:
            return word[0].upper()
        return word.upper() if value.isupper() else word.capitalize()
    fresh = iter(canonical)
    return "".join(next(fresh) if c.isalnum() else c for c in value)


def _propose(rows: DataFrame, key: str, turn: int) -> DataFrame:
    """(kind, canonical) with a ``surrogate`` column."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [surrogate(k, c, turn, key) for k, c in zip(batch.column("kind").to_pylist(), batch.column("canonical").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canonical"), pa.array(own, pa.string())],
                                             names=["kind", "canonical", "surrogate"])

    return rows.select("kind", "canonical").mapInArrow(draw, "kind string, canonical string, surrogate string")


def surrogates(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canonical, surrogate) of the distinct entities of ``mentions``: no two entities of a kind share a surrogate, and no surrogate
    is an entity that occurs. Of entities that draw the same, the smallest keeps it; the others draw again."""
    known = cut_lineage(mentions.groupBy("kind", "canonical").agg(F.lit(1).alias("one")).drop("one"))
    occurring = known.select("kind", F.col("canonical").alias("surrogate"))
    settled, open_ = None, known
    for turn in range(MAX_DRAWS):
        drawn = _propose(open_, key, turn).join(occurring, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            drawn = drawn.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        kept = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate")
        settled = cut_lineage(kept if settled is None else settled.unionByName(kept))
        open_ = cut_lineage(open_.join(settled, ["kind", "canonical"], "left_anti"))
        if open_.isEmpty():
            return settled
    raise ValueError(f"no distinct surrogates in {MAX_DRAWS} draws")


_MENTIONS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                      T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType())]))
_ARROW_MENTIONS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string())]))


def replace_entities(docs: DataFrame, key: str = KEY, text_col: str = "text", report: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced; all other columns, and clean texts, as they were.

    Null and empty texts stay; repeated rows are replaced alike; an entity has the same surrogate in every document and
    spelling. With ``report``, a column of that name (none of the input's) lists (start, end, kind, surrogate) in the original text. Columns of
    any name pass through. Only texts go to the workers; a text with entities is written once, to the checkpoint folder.
    """
    if report is not None and report.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {report}")
    found_col, row, drawn_col = (unused([*docs.columns, report or ""], f"_pii_{n}") for n in ("found", "row", "drawn"))

    def mentions_of(texts: pa.Array) -> pa.Array:
        # A slice at a time: a batch's texts are not all held as Python strings.
        lists = [[dict(zip(("start", "end", "kind", "canonical"), e, strict=True)) for e in (entities(t) if t else [])]
                 for begin in range(0, len(texts), TEXTS_AT_ONCE) for t in texts.slice(begin, TEXTS_AT_ONCE).to_pylist()]
        return pa.array(lists, _ARROW_MENTIONS)

    def any_of(texts: pa.Array) -> pa.Array:
        return pa.array([bool(t and entities(t)) for begin in range(0, len(texts), TEXTS_AT_ONCE)
                         for t in texts.slice(begin, TEXTS_AT_ONCE).to_pylist()], pa.bool_())

    def written(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        return pa.array([_written(t.as_py(), d.as_py()) for t, d in zip(texts, drawn, strict=True)], pa.string())

    text = quoted(text_col)
    untouched = docs.where(~F.arrow_udf(any_of, "boolean")(text))
    # Else the filter would be pushed below the column, and every text be searched for both.
    found = F.arrow_udf(mentions_of, _MENTIONS).asNondeterministic()(text)
    touched = docs.withColumn(found_col, found).where(F.size(found_col) > 0)
    touched = cut_lineage(touched.withColumn(row, F.monotonically_increasing_id()))
    mentions = touched.select(F.col(row).alias("row"), F.inline(found_col))
    drawn = surrogates(mentions, key)
    # A hot entity's mentions may be split by the optimizer; a document's mentions are bounded by its text.
    named = mentions.join(drawn, ["kind", "canonical"]).groupBy(F.col("row").alias(row)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias(drawn_col))
    done = touched.drop(found_col).join(named, row).withColumn(text_col, F.arrow_udf(written, "string")(text, F.col(drawn_col)))
    columns = [quoted(c) for c in docs.columns]
    if report is None:
        return done.select(*columns).unionByName(untouched.select(*columns))
    none = F.array().cast(done.schema[drawn_col].dataType)
    return done.select(*columns, F.col(drawn_col).alias(report)).unionByName(untouched.select(*columns, none.alias(report)))


def _written(text: str, drawn: list[dict]) -> str:
    parts, at = [], 0
    for d in drawn:
        parts += (text[at:d["start"]], shaped(d["kind"], text[d["start"]:d["end"]], d["surrogate"]))
        at = d["end"]
    return "".join(parts) + text[at:]
