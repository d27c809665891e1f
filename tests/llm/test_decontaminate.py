"""Suffix-automaton decontamination against plain comparison of windows."""

import hashlib
import random
import re

import pytest

from hedgewatch.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=10):
    passages = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if w else 0):
            passages.setdefault(tuple(w[p:p + n]), set()).add(item)
    sizes = {len(p) for p in passages}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := tuple(w[p:p + n])) in passages:
                    hit.update(range(p, p + n))
                    found |= passages[own]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(5)
    vocabulary = ["ab", "Cd", "é", "日本", "x1", "ß", "zz"]
    sentence = lambda n: " ".join(draw.choice(vocabulary[:3] if draw.random() < 0.5 else vocabulary) for _ in range(n))
    items = [(i, sentence(draw.choice([1, 3, 9, 10, 11, 25, 60]) if i > 3 else 40)) for i in range(30)]
    items = [i for i in items if len(words(i[1])) != 1 or i[0] < 12]
    items += [(90, ""), (91, None), (92, "... !!"), (3, items[3][1]), (93, items[3][1]), (None, sentence(12)), (94, "Only-these three"), (94, "other words")]
    docs = [(i, sentence(draw.choice([0, 1, 5, 30, 200]))) for i in range(60)]
    for i in range(60, 90):
        text = draw.choice(items)[1] or ""
        docs.append((i, f"{sentence(draw.randrange(20))}\n{text.upper() if i % 2 else text}, {sentence(draw.randrange(20))}"))
    docs += [(100, ""), (101, None), (102, "\x00 \x7f"), (103, ",".join(words(items[2][1]))), (103, ",".join(words(items[2][1]))), (None, items[0][1]),
             (104, "only THESE... three and other_words")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, tables):
    docs, items = tables
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS part", "3 AS item_id"),
            spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS passages"))


def test_whole_table_against_windows(frames, tables):
    assert rows(decontaminate.digests(*frames)) == slow(*tables)


def test_long_items_only(spark, frames, tables):
    items = [(i, t) for i, t in tables[1] if len(words(t)) >= 10]
    assert rows(decontaminate.digests(frames[0], spark.createDataFrame(items, "item_id long, text string"))) == slow(tables[0], items)


def test_many_automata_and_segments(spark, frames, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 7)
    found = decontaminate.with_hits(frames[0].select("doc_id", "text"), frames[1], keep_text=False, most=40)
    got = sorted(((r["doc_id"], r["_dec_words"], sum(b - a for a, b in r["_dec_hits"]), r["_dec_items"]) for r in found.collect()), key=repr)
    expected = slow(*tables)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [hashlib.sha256(",".join(g[3]).encode()).hexdigest() for g in got] == [e[4] for e in expected]


def test_text_in_blocks(monkeypatch, tables):
    passages = decontaminate.Passages([(str(i), len(words(t)) < 10, [w.encode() for w in words(t)]) for i, t in tables[1] if words(t)])
    text = " ".join(t or "" for _, t in tables[0]).encode()
    whole = passages.numbers(text).tolist()
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", 50)
    assert passages.numbers(text).tolist() == whole and len(whole) == sum(len(words(t)) for _, t in tables[0])


def test_empty_tables(spark, frames):
    none = frames[1].limit(0)
    assert decontaminate.digests(frames[0].limit(0), frames[1]).count() == 0
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.digests(frames[0], none).collect()} == {(0, 0, False)}
    with pytest.raises(ValueError, match="reserved"):
        decontaminate.with_hits(frames[0].selectExpr("*", "1 AS _dec_row"), none)


def test_passages_are_removed(spark):
    item = "One two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "twelve thirteen")], "item_id long, text string")
    around = " ".join(f"word{i}" for i in range(30))
    docs = [(1, f"{around}, {item.upper()}! The end"), (2, item), (3, f"{around} twelve thirteen"), (4, None), (5, ""), (6, around)]
    left = decontaminate.remove_passages(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS n_chars"), items)
    assert sorted(map(tuple, left.collect())) == [(1, f"{around}, ! The end", 7), (3, docs[2][1], 7), (4, None, 7), (5, "", 7), (6, around, 7)]


def test_planted_passages_of_the_table(spark, sf_dir):
    """Whole items put between words of no item are found, in full; the documents around them stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    planted = items.selectExpr("item_id + 1000000 AS doc_id", "concat('qqq1 ', text, ' qqq2') AS text", "item_id")
    found = {r["doc_id"]: r for r in decontaminate.with_hits(planted, items).collect()}
    own = {r["item_id"]: r["text"] for r in items.collect()}
    for doc, r in found.items():
        n = len(words(own[doc - 1000000]))
        assert r["_dec_words"] == n + 2 and [list(x) for x in r["_dec_hits"]] == [[1, n + 1]] and str(doc - 1000000) in r["_dec_items"]
