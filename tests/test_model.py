import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgewatch.operators import score, tfidf, train
from hedgewatch.sources import training

TEXTS = ["GET /a?id=1 union select", "the THE a", "é ß x", "", "aaaa aaaa", "GET /b select from", "sleep(5) union"]


def grams(text):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(2, 6):
            if len(padded) <= n:
                out.append(padded)
                break
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return Counter(out)


def test_word_ngrams_and_weights(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {}
    for r in tfidf.term_counts(docs, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["count"]
    expected = {i: dict(grams(t)) for i, t in enumerate(TEXTS) if grams(t)}
    assert got == expected

    df = Counter(t for g in expected.values() for t in g)
    total = Counter()
    for g in expected.values():
        total.update(g)
    kept = sorted(sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:12])
    vocab = tfidf.tfidf_vocab(docs, "text", max_features=12)
    rows = {r["term"]: r for r in vocab.collect()}
    assert [r["term"] for r in sorted(rows.values(), key=lambda r: r["index"])] == kept
    for t in kept:
        assert abs(rows[t]["idf"] - (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1)) < 1e-12
    weights = {}
    for r in train.tfidf_weights(docs, "text", vocab).collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for i, g in expected.items():
        raw = {t: (1 + math.log(c)) * rows[t]["idf"] for t, c in g.items() if t in rows}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert {t: round(w / norm, 9) for t, w in raw.items()} == {t: round(w, 9) for t, w in weights.get(i, {}).items()}


def test_texts(spark):
    df = spark.createDataFrame([("GET", "/p", None, "q2", "", "u" * 200, "0", "404")],
                               "method string, path string, query string, query_string string, content string, user_agent string, status string, status_code string")
    row = df.select(train.training_text(df.columns).alias("t"), score.serving_text(df.columns).alias("s")).first()
    assert row["t"] == f"GET /p q2  {'u' * 200} 404" and row["s"] == f"/p q2 {'u' * 200}"
    row = df.select(train.training_text(df.columns, 160).alias("t"), score.serving_text(df.columns, 100).alias("s")).first()
    assert row["t"] == f"GET /p q2  {'u' * 160} 404" and row["s"] == f"/p q2 {'u' * 100}"
    empty = spark.createDataFrame([(None,)], "method string")
    assert empty.select(train.training_text(empty.columns)).first()[0] == " " * 5


def test_threshold_sweep(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 3)) for _ in range(500)]
    best = (0.5, -1.0)
    for i in range(71):
        t = 0.9 if i == 70 else 0.2 + i * ((0.9 - 0.2) / 70)
        tp = sum(y == 1 and s >= t for y, s in rows)
        wrong = sum((y == 1) != (s >= t) for y, s in rows)
        f1 = 2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0
        best = (t, f1) if f1 > best[1] else best
    got = train.best_threshold(spark.createDataFrame(rows, "label int, score double")).first()
    assert (got["threshold"], round(got["f1"], 12)) == (best[0], round(best[1], 12))


def test_probability_choice(spark):
    df = spark.createDataFrame([([0.3, 0.7],)], "p array<double>")
    def value(classes):
        return round(df.select(score.choose_probability(F.col("p"), classes)).first()[0], 6)
    assert [value([0, 1]), value([1, 0]), value([0, 5]), value([4, 5]), value(None)] == [0.7, 0.3, 0.7, 0.7, 0.7]
    one = spark.createDataFrame([([0.3],)], "p array<double>")
    assert round(one.select(score.choose_probability(F.col("p"), None)).first()[0], 6) == 0.7


def test_merge(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.95, 0.0), (0.0, 0.589), (0.0, 0.588), (1.0, 1.0), (0.0, 0.5)], "rule_score double, ml_score double")
    merged = [r[0] for r in df.select(score.merged_score(F.col("rule_score"), F.col("ml_score"))).collect()]
    expected = [min(max(0.7 * c + 0.3 * r, 0.85 * c), 1.0) for r, c in [(1.0, 0.0), (0.95, 0.0), (0.0, 0.589), (0.0, 0.588), (1.0, 1.0), (0.0, 0.5)]]
    assert all(abs(a - b) < 1e-12 for a, b in zip(merged, expected))
    assert score.merge_and_flag(df).count() == 2


def test_split_is_stratified_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    parts = train.stratified_split(df, "id")
    assert {r["label"]: r["n"] for r in parts.filter("validation").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 135, 1: 15}
    again = train.stratified_split(df.repartition(3), "id").filter("validation")
    assert again.join(parts.filter("validation"), "id").count() == 150


def test_train_save_load_score(spark, tmp_path):
    rng = random.Random(2)
    attack = ["union select", "<script>alert", "../../etc/passwd", "sleep(5)"]
    with open(tmp_path / "t.jsonl", "w") as out:
        for i in range(240):
            bad = i % 3 == 0
            out.write(json.dumps({"method": "GET", "path": f"/p/{rng.randint(0, 50)}", "query": rng.choice(attack) if bad else f"page={i}",
                                  "status": 200, **({"label": rng.randint(1, 4)} if bad else {})}) + "\n" + ("\n" if i % 50 == 0 else ""))
    examples = training.read_training(spark, str(tmp_path / "t.jsonl"))
    assert examples.groupBy("label").count().orderBy("label").collect()[1]["count"] == 80
    model, metrics = train.train(examples, train.TrainParams(max_features=200, rounds=3, max_depth=3))
    training.save_model(model, metrics, str(tmp_path / "m"), "made up")
    loaded, meta = training.load_model(spark, str(tmp_path / "m"))
    row = meta.first()
    assert row["samples"] == 240 and row["features"] <= 200 and row["val_f1"] > 0.9 and row["taxonomy"] == ["normal", "attack"]
    log = spark.createDataFrame([(1, "/p/1", "q=union select"), (2, "/p/2", "page=7")], "line_number bigint, path string, query_string string")
    got = {r["line_number"]: r["ml_score"] for r in train.score(log, loaded).collect()}
    assert got[1] > 0.5 > got[2]


@pytest.mark.parametrize("line", ['{"path": "/a"', "[1]", "nothing", '{"path": "/a", "label": "often"}', '"text"'])
def test_broken_training_lines_stop_the_job(spark, tmp_path, line):
    (tmp_path / "t.jsonl").write_text('{"path": "/ok", "label": 1}\n\n' + line + "\n")
    with pytest.raises(Exception, match="not a (JSON object|label)"):
        training.read_training(spark, str(tmp_path / "t.jsonl")).collect()


def test_labels_as_text_number_and_boolean(spark, tmp_path):
    labels = ["1", '"1"', "true", "0", '"0"', "false", "null", "3", "1.0", '""']
    (tmp_path / "t.jsonl").write_text("".join(f'{{"path": "/{i}", "label": {v}}}\n' for i, v in enumerate(labels)) + '{"path": "/none"}\n')
    rows = {r["text"].split()[0]: r["label"] for r in training.read_training(spark, str(tmp_path / "t.jsonl")).collect()}
    assert [rows[f"/{i}"] for i in range(len(labels))] == [1, 1, 1, 0, 0, 0, 0, 1, 1, 0] and rows["/none"] == 0


def test_term_lists_agree_with_the_ngrams_of_each_row(spark, monkeypatch):
    """Whatever a task remembers and however many rows it counts together; equal ids are rows of their own."""
    texts = ["", None, "a", "Aa aA  aa\taaa", "größe Ünï 𝒳𝒳𝒳 x", "ab" * 130 + " ab ab", "x y x", "one two " * 40, "İstanbul ΣΑΣ"]
    rows = [(i % 5, t) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    expected = sorted((r["doc_id"], sorted(Counter(r["t"]).items())) for r in docs.select(
        "doc_id", tfidf.word_ngrams(F.col("text")).alias("t")).collect() if r["t"])

    def found():
        return sorted((r["doc_id"], sorted(zip(r["terms"], r["counts"]))) for r in tfidf.term_lists(docs, "doc_id", "text").collect())

    assert found() == expected
    df, total = Counter(), Counter()
    for _, terms in expected:
        df.update(t for t, _ in terms)
        total.update(dict(terms))
    batch = next(iter(docs.select("doc_id", tfidf.words(F.col("text")).alias("__words")).toArrow().to_batches()))
    one_by_one = type("OneByOne", (tfidf._Grams,), {"cut": lambda self, words: (
        np.array([self.number(n) for w in words for n in told[w]], np.int64), np.array([len(told[w]) for w in words]))})
    told = {r["w"]: r["t"] for r in docs.select(F.explode(tfidf.words(F.col("text"))).alias("w")).distinct().select(
        "w", tfidf.word_ngrams(F.col("w")).alias("t")).collect()}
    for terms, at_once, kind in ((500_000, 256, tfidf._Grams), (20, 4, tfidf._Grams), (1, 1, tfidf._Grams), (500_000, 1000, tfidf._Grams), (20, 4, one_by_one)):
        monkeypatch.setattr(tfidf, "TERMS", terms)
        monkeypatch.setattr(tfidf, "DOCUMENTS_AT_ONCE", at_once)
        grams, seen = kind(), []
        for part, row, term, count in tfidf._counted([batch], grams):
            names, ids = grams.named(term).to_pylist(), part.column("doc_id").to_pylist()
            for at in sorted(set(row.tolist())):
                seen.append((ids[at], sorted((names[i], int(count[i])) for i in (row == at).nonzero()[0])))
        assert sorted(seen) == expected
    vocab = {r["term"]: (r["df"], r["total"]) for r in tfidf.tfidf_vocab(docs, "text").collect()}
    assert vocab == {t: (n, total[t]) for t, n in df.items() if n >= 2}


def test_words_of_a_large_alphabet_are_cut_alike():
    words = ["".join(chr(0x4E00 + i * 7 + j) for j in range(6)) for i in range(2000)]
    many, few = tfidf._Grams(), tfidf._Grams()
    flat, sizes = many.cut(words)
    parts = [few.cut(words[i:i + 500]) for i in range(0, 2000, 500)]
    assert sizes.tolist() == [n for _, s in parts for n in s.tolist()]
    assert sorted(many.names[i] for i in flat) == sorted(few.names[i] for f, _ in parts for i in f)


def test_ngrams_of_a_task_are_not_made_by_nested_lambdas(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = tfidf.tfidf_vocab(docs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "flatten(" not in plan


@pytest.mark.parametrize("characters, terms", [(150_000, 500_000), (30, 500_000), (30, 5)])
def test_vectors_are_made_in_one_step(spark, monkeypatch, characters, terms):
    """Of ASCII rows and others, of rows too long to be coded with others, and of repeated and empty ones."""
    monkeypatch.setattr(tfidf, "CHARACTERS", characters)
    monkeypatch.setattr(tfidf, "TERMS", terms)
    monkeypatch.setattr(tfidf, "OPEN", terms)
    texts = [*TEXTS, "the größe the ab", "\x01ab the", "ab " * 40 + "the", "x", "nothing known", "GET /a?id=1 union select"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(2)
    vocab = tfidf.tfidf_vocab(docs, "text", doc_id="id")
    rows = {r["term"]: r for r in vocab.collect()}
    df, total = Counter(t for text in texts for t in grams(text)), sum((grams(t) for t in texts), Counter())
    assert {t: (r["df"], r["total"]) for t, r in rows.items()} == {t: (n, total[t]) for t, n in df.items() if n >= 2}
    vectors = train.vectorize(docs, "text", train.feature_stages(vocab), ["id"])
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "UDF(" not in plan  # no nested lambda, no vector opened and closed row by row
    found = {r["id"]: r["features"] for r in vectors.collect()}
    for i, text in enumerate(texts):
        raw = {rows[t]["index"]: (1 + math.log(c)) * rows[t]["idf"] for t, c in grams(text).items() if t in rows}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert found[i].size == len(rows) and found[i].indices.tolist() == sorted(raw)
        assert found[i].values.tolist() == pytest.approx([raw[k] / norm for k in sorted(raw)], abs=1e-12)


def test_a_score_is_found_once_for_all_thresholds(spark):
    scored = spark.createDataFrame([(1, 0.3), (0, -0.7)], "label int, x double").select("label", F.exp("x").alias("score"))
    plan = train.threshold_scores(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "EXP(" in line and "filter(" in line]) == 0 and plan.count("EXP(") == 1
