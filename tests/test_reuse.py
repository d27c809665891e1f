import random
import tracemalloc
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions import canonical, policy
from hedgewatch.functions.verdict import VERDICT
from hedgewatch.operators import reuse
from hedgewatch.plans.batch import with_reuse
from hedgewatch.sources import verdict_store as store

REQUEST = "method string, path string, query_string string, user_agent string"


def keys_of(spark, *requests):
    rows = [(i, *r) for i, r in enumerate(requests)]
    df = canonical.with_canonical_key(spark.createDataFrame(rows, "i int, " + REQUEST))
    return [r["canonical_key"] for r in df.orderBy("i").collect()]


def test_canonical_keys(spark):
    assert keys_of(
        spark,
        ("get", "//Shop//12/deadbeef99/x", "B=2&a=7&a=&k&&a-b=1", None),
        ("GET", "", None, "x SQLMap y"),
        ("GET", "/a", "u=10.0.0.1&h=localhost&d=0123456789abcdef", ""),
        ("GET", "/AAAABBBBCCCCDDDDEEEEFFFFGGGG/HHHH", None, None),
    ) == [
        "GET /shop/{id}/{hash}/x?a=&a={num}&a-b={num}&b={num}&k= ua=",
        "GET /? ua=scanner",
        "GET /a?d={hash}&h={internal_host}&u={ip} ua=",
        "GET /{encoded}? ua=",
    ]


def _mask(text):
    import re
    for pattern, replacement in canonical.mask_steps(config.KEY_BLOB_LENGTH):
        flags = re.I if "i" in pattern.split(")")[0] else 0
        text = re.sub(pattern.split(")", 1)[1], replacement, text, flags=flags)
    return text


def _key(method, path, query, agent):
    """One request's key, restated with plain string functions for the test."""
    import re
    def twice(s):
        return unquote(unquote(s or ""))
    path = re.sub("/+", "/", twice(path).lower() or "/")
    segments = path.split("/")
    out = segments[:1]
    for s in segments[1:]:
        out.append("{id}" if s.isdecimal() else "{hash}" if re.fullmatch("[0-9a-f]{8,}", s) else s)
    path = "/".join(out)
    path = path if path == "/" else _mask(twice(path).lower().strip())
    pairs = []
    for part in twice(query).split("&"):
        if part:
            k, _, v = part.partition("=")
            k, v = unquote(k.replace("+", " ")), unquote(v.replace("+", " "))
            pairs.append((k.lower(), _mask(twice(v).lower().strip())))
    shown = "&".join(f"{k}={v}" for k, v in sorted(pairs))
    scanner = any(s in twice(agent).lower() for s in config.SCANNER_AGENTS)
    return f"{method.upper()} {path}?{shown} ua={'scanner' if scanner else ''}"


def test_canonical_keys_of_random_requests(spark):
    rng = random.Random(3)
    pieces = ["/", "a", "Z", "7", "42", "%2F", "%252e", "%25", "%zz", "+", "&", "=", "é", " ", "deadbeef", "10.0.0.1",
              "localhost", "::1", " ", "-", "&&", "%C3%A9", "0123456789abcdef", "QUJDREVGR0hJSktMTU5PUFFS", "%ff", "?"]
    def text(n):
        return "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
    requests = [("get", "/" + text(8), rng.choice([None, text(10)]), rng.choice([None, "nmap", text(3)])) for _ in range(800)]
    for got, request in zip(keys_of(spark, *requests), requests):
        assert got == _key(*request), request


def test_payload_families(spark):
    values = ["x=../", "1 UNION  SELECT", "OR 12 = 3", "<script>", "{{7}}", "a;b", "http://10.0.0.1:80", "localhost", "a.PHP", "plain 77", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["f"] for r in canonical.with_payload_family(df, "v", "f").orderBy("i").collect()]
    assert got == ["{lfi}", "{sqli}", "{sqli}", "{xss}", "{ssti}", "{cmd}",
                   "http://{ip}:{num}",  # the port is masked first, so an address is no family
                   "{ssrf}", "{file_upload}", "plain {num}", ""]


def two_axes():
    """One axis per payload class, the diagonal for everything else."""
    def make():
        def embed(texts):
            return [[1, 0] if "etc/passwd" in t or "union" in t else [0, 2] if "/api" in t else [0.7, 0.7] for t in texts]
        return embed
    return make


def verdict(kind, confidence="0.9"):
    fields = {"attack_type": kind, "confidence": confidence, "severity": "high"}
    return F.struct(*[F.lit(fields.get(f.name)).cast(f.dataType).alias(f.name) for f in VERDICT.fields])


def flagged(spark, *rows):
    """``(line, path, query, types, rules)`` to flagged events."""
    schema = ("line_number bigint, path string, query_string string, attack_types array<string>, matched_rules array<string>")
    return spark.createDataFrame([r for r in rows], schema).withColumns({
        "method": F.lit("GET"), "user_agent": F.lit(None).cast("string"), "status_code": F.lit(200),
        "merged_score": F.lit(0.9), "rule_score": F.lit(0.8), "ml_score": F.lit(0.9), "source": F.lit("nginx"),
        "ts_iso": F.lit("2024-01-01T00:00:00+00:00"), "source_ip": F.concat(F.lit("10.0.0."), F.col("line_number").cast("string")),
        "raw_line": F.lit("x")})


def provider(kind="sqli", confidence=0.9):
    def make():
        return lambda requests: ['{"attack_type":"%s","confidence":%s}' % (kind, confidence)] * len(requests)
    return make


def resolve(spark, path, events, answer="sqli", confidence=0.9):
    batch = store.next_batch(spark, path)
    exact, entries = store.read_store(spark, path)
    result = with_reuse(events, exact, entries, provider(answer, confidence), two_axes())
    rows = {r["line_number"]: r for r in result.alerts.collect()}
    store.write_store(path, result.new_exact, result.entries, batch)
    return rows


def test_store_and_reuse(spark, tmp_path):
    path = str(tmp_path / "store")
    lfi, rule = ["lfi"], ["lfi_sensitive_file"]
    first = resolve(spark, path, flagged(spark, (1, "/../../etc/passwd", None, lfi, rule)), "path_traversal")
    assert not first[1]["cache_hit"] and first[1]["cache_hit_type"] is None
    later = resolve(spark, path, flagged(
        spark, (1, "/../../etc/passwd", None, lfi, rule),         # same request
        (2, "/x/etc/passwd", None, lfi, rule),                      # similar
        (3, "/api/users", None, lfi, rule),                         # unrelated
        (4, "/y/etc/passwd", None, ["xss"], ["xss_script"]),        # similar, other type
        (5, "/z/etc/passwd", None, [], [])), "lfi")                 # similar, no context
    assert [later[i]["cache_hit_type"] for i in range(1, 6)] == ["exact", "semantic", None, None, None]
    assert later[1]["cached_attack_type"] == "lfi" and later[1]["cache_similarity"] == 1.0
    assert later[2]["cache_decision_reason"] == "same_attack_type:lfi similarity>=0.87"
    assert later[2]["matched_rules"] == rule and later[2]["input_tokens"] == 0
    exact, entries = store.read_store(spark, path)
    assert exact.count() == 4 and entries.agg(F.sum("hit_count")).first()[0] == 1
    store.compact_store(spark, path)
    assert store.read_store(spark, path)[0].count() == 4
    store.clear_store(spark, path)
    assert [t.count() for t in store.read_store(spark, path)] == [0, 0]


def test_normal_verdicts_are_exact_only(spark, tmp_path):
    path = str(tmp_path / "store")
    resolve(spark, path, flagged(spark, (1, "/home", None, [], [])), "normal")
    assert store.read_store(spark, path)[1].count() == 0
    again = resolve(spark, path, flagged(spark, (1, "/home", None, [], []), (2, "/home2", None, [], [])), "normal")
    assert [again[i]["cache_hit_type"] for i in (1, 2)] == ["exact", None]


def test_decisions(spark):
    cases = [  # cached type, family, confidence, similarity, context, context family
        ("normal", "normal", 1.0, 1.0, "sqli", "sqli", False, "cached_type_exact_only:normal"),
        ("sqli", "sqli", 0.79, 1.0, "sqli", "sqli", False, "cached_confidence_below_0.8"),
        ("sqli", "sqli", 0.9, 0.84, "sqli", "sqli", False, "similarity<0.85"),
        ("sqli", "sqli", 0.9, 0.86, "cve", "cve", False, "similarity<0.92"),
        ("sqli", "sqli", 0.9, 0.86, "unknown", "unknown", False, "unknown_context_no_semantic_reuse"),
        ("sqli", "sqli", 0.9, 0.86, "xss", "xss", False, "attack_type_mismatch:xss!=sqli"),
        ("sqli", "xss", 0.9, 0.86, "xss", "xss", True, "same_rule_family:xss similarity>=0.85"),
        ("sqli", "sqli", 0.9, 0.86, "sqli", "x", True, "same_attack_type:sqli similarity>=0.85"),
    ]
    df = spark.createDataFrame(cases, "c string, f string, k double, s double, t string, u string, a boolean, r string")
    args = [F.col(x) for x in "cfkstu"]
    for row in df.withColumn("d", policy.similarity_decision(*args)).collect():
        assert (row["d"]["accepted"], row["d"]["reason"]) == (row["a"], row["r"])
    free = df.limit(3).withColumn("d", policy.similarity_decision(
        *[F.col(x) for x in "cfks"], F.lit("unknown"), F.lit("unknown"), has_context=False))
    assert [r["d"]["accepted"] for r in free.collect()] == [False, False, False]


def test_top1_prefers_the_oldest_of_equals(spark):
    entries = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0])], "seq bigint, embedding array<float>")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "i int, embedding array<float>")
    assert {r["i"]: r["best_seq"] for r in reuse.top1(df, entries).collect()} == {1: 3, 2: 9}
    assert all(r["best_seq"] is None and r["similarity"] is None for r in reuse.top1(df, entries.limit(0)).collect())


def test_eviction_keeps_the_newest(spark):
    rows = spark.range(1, 21).select(
        F.col("id").alias("line_number"), F.col("id").cast("string").alias("canonical_key"),
        F.when(F.col("id") % 5 == 0, verdict("csrf")).when(F.col("id") % 5 == 1, verdict("xss", "0.5")).otherwise(verdict("xss")).alias("verdict"),
        F.when(F.col("id") != 19, F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")).alias("embedding"),
        F.array(F.lit("sqli_a")).alias("matched_rules"))
    empty = spark.createDataFrame([], store.ENTRIES)
    first = reuse.admit_entries(empty, rows, 3)
    assert sorted(r["seq"] for r in first.collect()) == [14, 17, 18]
    second = reuse.admit_entries(first, rows.filter("line_number = 2"), 3)
    assert sorted(r["seq"] for r in second.collect()) == [17, 18, 20]
    assert {r["rule_family"] for r in second.collect()} == {"sqli"}


def _fits(context, stored):
    return stored is not None and (stored in ("unknown", "normal") if context == "unknown" else stored == context)


@pytest.mark.parametrize(("width", "chain"), [(1, 5), (7, 256), (7, 3), (1000, 2), (1000, 256)])
def test_fold_equals_a_line_by_line_replay(spark, monkeypatch, width, chain):
    rng = random.Random(width)
    kinds = ["sqli", "xss", "unknown", "cve"]
    names = ["hot", "b", "c", "d", "only"]
    rows = []
    for line in range(1, 600):
        key = "hot" if rng.random() < 0.6 else rng.choice(names)
        rows.append((line, key, "xss" if key == "only" else rng.choice(kinds if rng.random() < 0.4 else kinds[:2])))
    own = {(k, c): rng.choice([c, c, "csrf", "normal", "sqli"]) for k in names for c in kinds}
    stored = {k: rng.choice([None, "sqli", "unknown"]) for k in names}
    near = {(k, c): rng.random() < 0.2 for k in names for c in kinds}

    state = {k: ("store", stored[k]) for k in names}
    expected = {}
    for line, key, context in rows:
        if _fits(context, state[key][1]):
            expected[line] = ("exact", state[key][0])
        elif near[key, context]:
            expected[line] = ("semantic", None)
        else:
            expected[line] = ("miss", None)
            state[key] = (context, own[key, context])

    events = spark.createDataFrame(rows, "line_number bigint, canonical_key string, context_type string").withColumn(
        "context_family", F.col("context_type"))
    first = {}
    for line, key, context in rows:
        first.setdefault((key, context), line)
    classes = reuse.number_classes(spark.createDataFrame([
        (k, c, c, line, _fits(c, stored[k]) if stored[k] else None, near[k, c], own[k, c]) for (k, c), line in first.items()],
        "canonical_key string, context_type string, context_family string, first_line bigint, exact_ok boolean, "
        "accepted boolean, verdict_type string"))
    names_of = {(r["canonical_key"], r["class_no"]): r["context_type"] for r in classes.collect()}
    monkeypatch.setattr(reuse, "CHAIN", chain)
    folded = reuse.fold_reuse(events, classes, bucket_lines=width)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    got = folded.collect()
    assert len(got) == len(rows)
    for r in got:
        outcome, source = expected[r["line_number"]]
        assert r["outcome"] == outcome, r
        if outcome == "exact":
            used = "store" if r["state"] == 0 else names_of[r["canonical_key"], r["state"]]
            assert used == source, r


def test_previous_in_key_across_buckets(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice(["x", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "line_number bigint, k string, v string")
    got = {r["line_number"]: r["p"] for r in reuse.previous_in_key(df, ["k"], "line_number", "v", "p", 13).collect()}
    last = {}
    for line, key, value in rows:
        assert got[line] == last.get(key), line
        last[key] = value


def test_embedding_is_unit_length_and_truncated_on_demand(spark):
    df = spark.createDataFrame([("a" * 700,), ("zero",)], "canonical_key string")

    def embedder():
        return lambda texts: [[0.0, 0.0] if t == "zero" else [float(len(t) == 512), 3.0] for t in texts]

    whole = {r["canonical_key"][:4]: r["embedding"] for r in reuse.embed_keys(df, embedder).collect()}
    assert np.allclose(whole["aaaa"], [0, 1])
    got = {r["canonical_key"][:4]: r["embedding"] for r in reuse.embed_keys(df, embedder, truncate=512).collect()}
    assert np.allclose(got["aaaa"], np.array([1, 3]) / np.sqrt(10)) and got["zero"] == [0.0, 0.0]
    fixed = reuse.HashedNgrams(16)()
    assert np.array_equal(fixed(["abc"])[0], fixed(["abc"])[0]) and len(fixed(["abc"])[0]) == 16


def test_large_stores_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stored, asked = rng.integers(-3, 4, (60, 5)).astype(float), rng.integers(-3, 4, (90, 5)).astype(float)
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "seq bigint, embedding array<float>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id bigint, embedding array<float>")
    monkeypatch.setattr(reuse, "ROWS_AT_ONCE", 25)
    small = sorted(map(tuple, reuse.top1(df, entries).select("id", "best_seq", "similarity").collect()))
    blocks = sorted(map(tuple, reuse.top1(df, entries, max_bytes=7 * 8 * 5).select("id", "best_seq", "similarity").collect()))
    assert small == blocks
    assert blocks == [(i, int((stored @ v).argmax()), float((stored @ v).max())) for i, v in enumerate(asked)]


def test_products_are_made_a_tile_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(6)
    stored, asked = rng.integers(-3, 4, (4000, 4)).astype(float), rng.integers(-3, 4, (3000, 4)).astype(float)
    stored[70] = np.nan
    expected = asked @ stored.T
    tracemalloc.start()
    best, most = reuse._best_of(asked, stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(best, expected.argmax(axis=1)) and np.isnan(most).all()
    assert peak < 0.6 * expected.nbytes
    monkeypatch.setattr(reuse, "TILE", (7, 9))
    for known in (stored, stored[:70]):
        best, most = reuse._best_of(asked, known)
        products = asked @ known.T
        assert np.array_equal(best, products.argmax(axis=1))
        assert np.array_equal(most, products[np.arange(len(asked)), best], equal_nan=True)


def test_hashed_ngrams_alike_in_both_forms(spark):
    keys = ["", "a", "GET|/p/{num}|q=é", "x" * 700]
    df = spark.createDataFrame([(k,) for k in keys], "canonical_key string")
    column = {r[0]: r[1] for r in reuse.embed_keys(df, reuse.HashedNgrams(16)).collect()}
    called = {r[0]: r[1] for r in reuse.embed_keys(df, lambda: reuse.HashedNgrams(16)()).collect()}
    for k in keys:
        assert np.allclose(column[k], called[k], atol=1e-6)
    far = spark.createDataFrame([("x" * 600 + "abc",), ("x" * 600 + "zyw",)], "canonical_key string")
    a, b = (r[1] for r in reuse.embed_keys(far, reuse.HashedNgrams(16)).collect())
    assert a != b  # keys are embedded whole


def test_failing_embeddings_are_misses(spark):
    from hedgewatch.functions.verdict import VERDICT
    from hedgewatch.sources.verdict_store import ENTRIES, EXACT

    def embedder():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot embed")
            return reuse.HashedNgrams(16)()(texts)
        return embed

    assert VERDICT and EXACT
    classes = spark.createDataFrame([("good", "sqli", "sqli"), ("bad", "sqli", "sqli"), ("fine", "xss", "xss")], "canonical_key string, context_type string, context_family string")
    found = reuse.lookup_classes(classes, spark.createDataFrame([], EXACT), spark.createDataFrame([], ENTRIES), embedder)
    rows = {r["canonical_key"]: r for r in reuse.lookup_outcome(found).collect()}
    assert {k: r["reason"] for k, r in rows.items()} == {"good": "empty_cache", "fine": "empty_cache", "bad": "lookup_failed"}
    assert {r["hit_type"] for r in rows.values()} == {"miss"} and rows["bad"]["embedding"] is None and rows["good"]["embedding"] is not None


def test_a_hot_key_is_dealt_over_buckets(spark):
    """One key with half the rows meets its class in many groups, not in one."""
    events = spark.range(2000).selectExpr("id AS line_number", "IF(id % 2 = 0, 'hot', concat('k', id % 50)) AS canonical_key")
    few = events.select("canonical_key").distinct().selectExpr("canonical_key", "length(canonical_key) AS n")
    joined = reuse.join_dealt(events, few, ["canonical_key"], bucket_lines=100)
    assert joined.count() == 2000 and joined.where("n <> length(canonical_key)").isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reuse.join_dealt(events, few, ["canonical_key"], bucket_lines=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re
    with_lines = [p for p in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "__bucket" in p]
    assert with_lines  # the events' side is dealt by key and bucket
