from pyspark.sql import functions as F

from hedgewatch.functions.verdict import VERDICT
from hedgewatch.plans.session import Options
from hedgewatch.sources import verdict_store
from hedgewatch.streaming import incremental

TIME = "[22/Jan/2019:04:01:00 +0330]"


def line(path, agent="ua"):
    return f'10.0.0.1 - - {TIME} "GET {path} HTTP/1.1" 200 1 "-" "{agent}" "-"\n'


def test_incremental_batches_build_on_each_other(spark, tmp_path):
    def scorer(log):
        return log.withColumn("ml_score", F.when(F.contains("path", F.lit("quiet")), 0.1).otherwise(0.9))

    def provider():
        return lambda requests: ['{"attack_type":"lfi","confidence":0.9}'] * len(requests)

    logs, out, store = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "store")
    logs.mkdir()
    options = Options(scorer=scorer, provider=provider, store_path=store)

    def run():
        incremental.run_incremental(spark, str(logs), out, str(tmp_path / "check"), options).awaitTermination()

    (logs / "a.log").write_text(line("/etc/passwd") + line("/quiet") + line("/etc/passwd"))
    run()
    (logs / "b.log").write_text(line("/etc/passwd") + line("/x/etc/shadow") + "junk\n")
    run()
    run()  # nothing new
    rows = {r["line_number"]: r for r in spark.read.parquet(f"{out}/alerts").collect()}
    assert {n: r["cache_hit_type"] for n, r in rows.items()} == {1: None, 3: "exact", 4: "exact", 5: None}
    assert [(r["batch"], r["lines"], r["processed"]) for r in incremental.stream_progress(spark, out).orderBy("batch").collect()] == [
        (0, 3, 3), (1, 3, 6)]
    exact, entries = verdict_store.read_store(spark, store)
    assert exact.count() == 2 and entries.count() == 2
    # a store read as of an earlier batch does not see later ones
    assert verdict_store.read_store(spark, store, before_batch=2)[0].count() == 1


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_keyed_state_survives_batches(spark, tmp_path):
    schema = "canonical_key string, context_type string, line_number bigint, verdict_type string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        kinds = {f.name: F.lit(None).cast(f.dataType) for f in VERDICT.fields} | {
            "attack_type": F.col("verdict_type"), "explanation": F.concat(F.lit("line "), F.col("line_number").cast("string"))}
        events = stream.withColumns({"verdict": F.struct(*[c.alias(n) for n, c in kinds.items()]), "context_family": F.lit("family")})
        incremental.stream_reuse(events, str(tmp_path / "store"), out, str(tmp_path / "check")).awaitTermination()

    feed(spark, source, [("k", "xss", 2, "xss"), ("k", "sqli", 1, "csrf"), ("j", "unknown", 3, "normal")], schema)
    run()
    feed(spark, source, [("k", "xss", 4, "xss"), ("j", "unknown", 5, "sqli"), ("k", "sqli", 6, "sqli"), ("k", "unknown", 7, "unknown")], schema)
    run()
    got = {r["line_number"]: (r["outcome"], r["reused_type"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("miss", None), 2: ("miss", None), 3: ("miss", None), 4: ("exact", "xss"), 5: ("exact", "normal"),
                   6: ("miss", None), 7: ("miss", None)}
    said = {r["line_number"]: r["verdict"]["explanation"] for r in spark.read.parquet(out).collect()}
    assert said == {1: "line 1", 2: "line 2", 3: "line 3", 4: "line 2", 5: "line 3", 6: "line 6", 7: "line 7"}


def test_streamed_upsert_over_batches(spark, tmp_path):
    schema = ("line_number bigint, timestamp string, source_ip string, path string, merged_score double, severity string, arrival bigint")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.stream_upsert(stream, out, str(tmp_path / "check")).awaitTermination()

    feed(spark, source, [(1, "t", "i", "p", 0.5, "low", 9), (1, "t", "i", "p", 0.5, "high", 10), (2, "t", "i", "p", 0.5, "low", 1)], schema)
    run()
    feed(spark, source, [(1, "t", "i", "p", 0.5, "medium", 2), (3, "t", "i", "p", 0.5, "low", 3)], schema)
    run()
    got = {r["line_number"]: r["severity"] for r in incremental.latest_upsert(spark, out).collect()}
    assert got == {1: "medium", 2: "low", 3: "low"}
