import json
import random

import pytest
from pyspark.sql import functions as F

from hedgewatch.functions import severity
from hedgewatch.functions.verdict import VERDICT, confidence_value
from hedgewatch.operators import alerts, metrics, search, verdicts
from hedgewatch.plans.batch import without_reuse


def parse(spark, *answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, raw string")
    return [r["verdict"] for r in verdicts.parse_verdict(df).orderBy("i").collect()]


def test_answers(spark):
    v = parse(
        spark,
        '{"label":1,"attack_type":"xss","confidence":0.5,"recommended_actions":["a","b"],"cve_refs":["C"],"new":{"x":1}}',
        ' ```json\n{"attack_type":"sqli","confidence":"0.9"}\n``` ',
        '```\n{"confidence":null}\n```', '{"confidence":"high"}', "{}", "{broken", "[1]", None, "")
    assert (v[0]["attack_type"], v[0]["recommended_actions"], v[0]["cve_refs"], v[0]["label"]) == ("xss", ["a", "b"], ["C"], 1)
    assert json.loads(v[0]["raw"])["new"] == {"x": 1}
    assert v[1]["attack_type"] == "sqli" and v[2]["confidence"] == "null" and v[4]["confidence"] is None
    for failed in v[5:]:
        assert (failed["attack_type"], failed["severity"], failed["recommended_actions"]) == ("unknown", "medium", ["monitor"])
        assert failed["input_tokens"] == 0 and failed["ttft_ms"] is None
    df = spark.createDataFrame([(x["confidence"],) for x in v[:5]] + [("true",), ("1e-1",)], "c string")
    assert [r[0] for r in df.select(confidence_value(F.col("c"))).collect()] == [0.5, 0.9, 0.0, 0.0, 1.0, 1.0, 0.1]


def event(spark, n=1):
    return spark.range(1, n + 1).select(
        F.col("id").alias("line_number"), F.lit("GET").alias("method"), F.lit("/a%2541\nb").alias("path"),
        F.lit("q=%2527").alias("query_string"), F.lit("").alias("user_agent"), F.lit(404).alias("status_code"),
        F.lit(0.7735).alias("merged_score"), F.lit(0.45).alias("rule_score"), F.lit(0.91).alias("ml_score"),
        F.array(F.lit("sqli"), F.lit("xss")).alias("attack_types"),
        F.array(*[F.lit(f"r{i}") for i in range(10)]).alias("matched_rules"), F.lit("apache").alias("source"),
        F.lit("2024-01-01T00:00:00+00:00").alias("ts_iso"), F.lit("1.2.3.4").alias("source_ip"), F.lit("x").alias("raw_line"))


def test_request_text(spark):
    row = verdicts.with_request(event(spark)).first()
    short = verdicts.with_request(event(spark), verdicts.SHORT).first()
    for summary, rules in ((row["event_summary"], "r0,r1,r2,r3,r4,r5,r6,r7,r8,r9"), (short["event_summary"], "r0,r1,r2,r3,r4,r5,r6,r7")):
        assert summary == "\n".join([
            "method=GET", "path=/aA b", "status=404", f"merged_score={0.7735:.3f}", "rule_score=0.450", "ml_score=0.910",
            "query=q='", "rule_attack_types=sqli,xss", f"matched_rules={rules}"])
    long = event(spark).withColumns({"path": F.lit("/" + "p" * 300), "user_agent": F.lit("u" * 300)})
    assert "p" * 300 in verdicts.with_request(long).first()["request"] and "u" * 300 in verdicts.with_request(long).first()["request"]
    cut = verdicts.with_request(long, verdicts.SHORT).first()["request"]
    assert "path=/" + "p" * 179 + "\n" in cut and "user_agent=" + "u" * 120 + "\n" in cut
    assert row["context_summary"].splitlines()[2:] == ["source=apache", "rule_attack_types=sqli,xss", "matched_rule_count=10"]
    assert row["request"].endswith("Matched Local Rules:\n" + str([f"r{i}" for i in range(10)]))
    plain = verdicts.with_request(event(spark).withColumns({
        "matched_rules": F.array().cast("array<string>"), "attack_types": F.array().cast("array<string>")})).first()
    assert "rule_attack_types=none" in plain["request"] and "Matched" not in plain["request"]


def test_provider_failures_become_fallbacks(spark):
    def failing():
        raise RuntimeError("no connection")
    rows = without_reuse(event(spark, 3), failing).alerts.collect()
    assert len(rows) == 3 and {r["analysis"]["attack_type"] for r in rows} == {"unknown"}
    assert {(r["severity"], r["cache_hit"], r["cache_hit_type"]) for r in rows} == {("medium", False, None)}
    def some():
        return lambda texts: [{"text": '{"severity":"CRIT "}', "input_tokens": 3, "model": "m"}] * len(texts)
    (row,) = without_reuse(event(spark), some).alerts.collect()
    assert (row["severity"], row["input_tokens"], row["analysis"]["model"]) == ("critical", 3, "m")


def test_severities(spark):
    df = spark.createDataFrame([(" Crit", 0.1), ("med", 0.1), ("warn", 0.1), ("informational", 0.9), ("x", 0.85), (None, 0.7),
                                ("", 0.5), ("x", 0.49)], "s string, m double")
    rows = df.select(severity.alert_severity(F.lit("?"), F.col("s"), F.col("m"))).collect()
    assert [r[0] for r in rows] == ["critical", "medium", "medium", "low", "critical", "high", "medium", "low"]


def table(spark, rows):
    """``(line, score, timestamp, severity, type)`` to alerts."""
    df = spark.createDataFrame(rows, "line_number bigint, merged_score double, timestamp string, severity string, kind string")
    fields = {"attack_type": F.col("kind"), "explanation": F.lit("It's clear"), "recommended_actions": F.array(F.lit("block_ip"), F.lit("nap")),
              "cve_refs": F.array(F.lit("CVE-1"), F.lit("CVE-2"))}
    analysis = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VERDICT.fields])
    return df.withColumns({
        "source_ip": F.concat(F.lit("10.0.0."), F.col("line_number").cast("string")), "method": F.lit("GET"), "path": F.lit("/P"),
        "query_string": F.lit(None).cast("string"), "status_code": F.lit(200), "user_agent": F.lit("UA"), "raw_line": F.lit(""),
        "matched_rules": F.array(F.lit("a'b"), F.lit("c")), "attack_types": F.array().cast("array<string>"), "analysis": analysis})


ROWS = [(1, 0.9, "2024-01-01T10:00:00+03:30", "high", "sqli"), (2, 0.5, "2024-01-01T09:00:00+00:00", "low", None),
        (3, 0.9, "2024-01-01T10:00:00+03:30", None, "xss"), (4, 0.6, "2024-01-02T00:00:00+00:00", "bad", "xss")]


def test_filters(spark):
    t = table(spark, ROWS)
    def found(**filters):
        return sorted(r["line_number"] for r in search.filter_alerts(t, **filters).collect())
    assert found() == [1, 2, 3, 4] and found(severity=[]) == [1, 2, 3, 4]
    assert found(severity=["critical", "medium"]) == [3, 4]
    assert found(attack_type=["unknown"]) == [2] and found(ip="0.0.3") == [3]
    assert found(search="\"A'B\", 'c'") == [1, 2, 3, 4] and found(search="a'b,c", dashboard=True) == [1, 2, 3, 4]
    assert found(search="a'b,c") == [] and found(search="/p 200 ua") == [1, 2, 3, 4] and found(search="high") == [1]
    assert found(search="high", dashboard=True) == []


def test_pages(spark):
    t = table(spark, ROWS)
    def page(**how):
        return [r["line_number"] for r in search.page_of(t, **how).orderBy("rank").collect()]
    assert page() == [4, 3, 2, 1] and page(sort_by="nonsense", sort_order="x") == [1, 2, 3, 4]
    assert page(sort_by="merged_score") == [1, 3, 4, 2] and page(sort_by="merged_score", sort_order="asc") == [2, 4, 1, 3]
    assert page(sort_by="timestamp") == [4, 1, 3, 2]  # by text: 10:00+03:30 is after 09:00+00:00
    assert page(page=2, page_size=3) == [1] and page(page=0, page_size=0) == [4] and page(page=9) == []
    assert search.totals(t, 3).first().asDict() == {"total": 4, "total_pages": 2}
    assert search.totals(t.limit(0)).first().asDict() == {"total": 0, "total_pages": 1}
    span = search.date_range(search.page_of(t, sort_by="timestamp")).first()
    assert (span["first"], span["last"]) == (ROWS[1][2], ROWS[3][2])


def test_counts_sessions_and_references(spark):
    t = table(spark, ROWS)
    assert {r["severity"]: r["alerts"] for r in search.severity_counts(t).collect()} == {
        "critical": 1, "high": 1, "medium": 1, "low": 1, "noimpact": 0}
    assert [r["attack_type"] for r in search.attack_types(t).collect()] == ["sqli", "unknown", "xss"]
    assert sorted(r["label"] for r in alerts.recommended_actions(t).filter("line_number = 1").collect()) == ["Block 10.0.0.1", "nap"]
    assert alerts.cve_references(t).filter("position = 1").first()["link"].endswith("/CVE-2")
    schema = "session_id string, status string, created_at double"
    done = [("a", "done", 5.0), ("b", "idle", 9.0)]
    running = [("c", "processing", 8.0), ("d", "processing", 7.0)]
    assert search.latest_session(spark.createDataFrame(done, schema)).first()[0] == "b"
    assert search.latest_session(spark.createDataFrame(done + running, schema)).first()[0] == "d"
    s = spark.createDataFrame(done, schema)
    mine = t.withColumn("session_id", F.lit("a"))
    assert {r["session_id"]: r["total_alerts"] for r in search.session_summary(s, mine).collect()} == {"a": 4, "b": 0}
    assert search.session_alerts(mine, "b", s).count() == 0
    with pytest.raises(LookupError):
        search.session_alerts(mine, "zz", s)


def test_upsert_keeps_the_newest(spark):
    rows = [(1, 0.1, "t", "low", "a", 1), (1, 0.2, "t", "high", "a", 3), (1, 0.3, "t", "medium", "a", 2), (None, 0.1, "t", "low", "a", 4)]
    df = spark.createDataFrame(rows, "line_number bigint, merged_score double, timestamp string, severity string, path string, arrival bigint"
                               ).withColumn("source_ip", F.lit(None).cast("string"))
    got = {r["alert_key"]: r["severity"] for r in search.upsert(df).collect()}
    assert got == {"line:1": "high", "t||a|0.1": "low"}


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 40, 1000])
def test_p95_element(spark, n):
    rng = random.Random(n)
    values = [round(rng.choice([1.0, rng.random() * 9, rng.random() * 1000]), 2) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms double")
    assert metrics.latency_p95(df).first()[0] == sorted(values)[int(n * 0.95)]
    if n == 1000:
        assert abs(metrics.latency_p95(df, exact=False).first()[0] - sorted(values)[949]) < 5


def test_metrics_of_nothing_and_progress(spark):
    none = spark.createDataFrame([], "latency_ms double, line_number bigint")
    empty = spark.createDataFrame([], "cache_hit boolean, cache_hit_type string, input_tokens bigint, output_tokens bigint")
    row = metrics.session_metrics(none, empty).first()
    assert (row["total_lines"], row["latency_p95_ms"], row["cache_hit_rate"], row["throughput_ev_s"], row["cache_hit_types"]) == (0, 0.0, 0.0, 0.0, {})
    assert metrics.session_metrics(None, empty, 5).first()["total_lines"] == 5
    marks = metrics.progress(spark.range(1, 251).withColumnRenamed("id", "line_number"))
    assert sorted(r["processed"] for r in marks.collect()) == list(range(2, 251, 2))


def test_documents_round_scores_and_keep_nulls(spark):
    t = table(spark, [(1, 0.123456, "t", "low", "sqli")]).withColumns({
        "rule_score": F.lit(0.98765), "ml_score": F.lit(0.5), "cache_hit": F.lit(False), "cache_hit_type": F.lit(None).cast("string"),
        "cache_similarity": F.lit(None).cast("double"), "cached_attack_type": F.lit(None).cast("string"),
        "cache_decision_reason": F.lit(None).cast("string"), "cache_policy_mode": F.lit(None).cast("string")})
    doc = json.loads(alerts.alerts_json(t).first()["json"])
    assert (doc["merged_score"], doc["rule_score"], doc["cache_similarity"], doc["query_string"]) == (0.1235, 0.9877, None, None)
    assert "input_tokens" not in doc and doc["analysis"]["attack_type"] == "sqli"


def test_only_failing_requests_fall_back(spark):
    from hedgewatch.operators.verdicts import infer_verdicts

    def provider():
        def complete(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad one")
            return texts[:1] if len(texts) == 3 else [t.upper() for t in texts]
        return complete

    requests = spark.createDataFrame([(f"{'bad' if i % 10 == 0 else 'good'} {i}",) for i in range(43)], "request string").coalesce(1)
    rows = infer_verdicts(requests, provider, at_once=4).collect()
    assert {r["request"] for r in rows if r["raw"] is None} == {f"bad {i}" for i in range(0, 43, 10)}
    assert all(r["raw"] == r["request"].upper() and r["error"] is None for r in rows if r["raw"])
    assert {r["error"] for r in rows if r["raw"] is None} == {"ValueError: bad one"}


def test_provider_that_cannot_be_made_is_told(spark):
    from hedgewatch.operators.verdicts import infer_verdicts

    def failing():
        raise OSError("no key")
    (row,) = infer_verdicts(spark.createDataFrame([("x",)], "request string"), failing).collect()
    assert (row["raw"], row["error"]) == (None, "no provider: OSError: no key")
