import uuid

import pytest
from pyspark.sql import functions as F

from hedgewatch.operators import search, text_index

ALERT = ("session_id string, line_number bigint, source_ip string, method string, path string, query_string string, status_code int, "
         "user_agent string, raw_line string, matched_rules array<string>, attack_types array<string>, severity string, merged_score double, "
         "analysis struct<attack_type:string,severity:string,explanation:string,cve_refs:array<string>>")


def alerts(spark, start, end):
    return spark.range(start, end).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("session_id"), F.col("id").alias("line_number"),
        F.concat(F.lit("10.0.0."), F.col("id") % 256).alias("source_ip"), F.lit("GET").alias("method"),
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("/Größe/"), F.col("id"))).otherwise(F.lit("/same")).alias("path"),
        F.when(F.col("id") == 777, F.lit("needle=Ünique𝒳x")).alias("query_string"), F.lit(200).alias("status_code"),
        F.lit(None).cast("string").alias("user_agent"), F.lit("").alias("raw_line"),
        F.array(F.lit("a"), F.lit("b")).alias("matched_rules"), F.array().cast("array<string>").alias("attack_types"),
        F.when(F.col("id") % 2 == 0, "high").alias("severity"), F.lit(0.5).alias("merged_score"),
        F.struct(F.lit("XSS").alias("attack_type"), F.lit(None).cast("string").alias("severity"), F.lit("why").alias("explanation"),
                 F.lit(None).cast("array<string>").alias("cve_refs")).alias("analysis"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / str(uuid.uuid4()))
    text_index.add_to_text_index(alerts(spark, 0, 1500), path, 0, block_rows=100)
    text_index.add_to_text_index(alerts(spark, 1500, 2000), path, 1, block_rows=100)
    text_index.add_to_text_index(alerts(spark, 1500, 2000), path, 1, block_rows=100)  # a retry
    return path


@pytest.mark.parametrize("text", ["/größe/1", "ÜNIQUE", "𝒳x", "nee", "/same", "ab", "", "['a', 'b']", "not there", "ique𝒳x", "10.0.0.77 get", "high"])
def test_index_gives_what_the_scan_gives(spark, index, text):
    whole = alerts(spark, 0, 2000)
    for severity in (None, ["high"]):
        expected = search.filter_alerts(whole, severity, search=text)
        found = text_index.search_index(spark, index, text, severity)
        assert found.columns == whole.columns
        assert sorted(r["line_number"] for r in found.collect()) == sorted(r["line_number"] for r in expected.collect())


def test_only_blocks_that_may_hold_the_text_are_opened(spark, index):
    def opened(text):
        return len(text_index.blocks_of(spark, index, text))
    assert opened("needle=ün") == 1 and len(text_index.search_index(spark, index, "needle=Ün").inputFiles()) == 1
    assert opened("not there") == 0 and opened("/größe/1950") == 1
    assert opened("/same") >= 20 and text_index.blocks_of(spark, index, "ab") is None
    # places, not only blocks, must agree: every block holds both parts, no row does
    assert opened("/same größe") == 0


def test_empty_and_missing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        text_index.search_index(spark, str(tmp_path / "none"), "abc")
    path = str(tmp_path / "empty")
    text_index.add_to_text_index(alerts(spark, 0, 0), path, 0)
    assert text_index.search_index(spark, path, "same").count() == 0
    text_index.add_to_text_index(alerts(spark, 0, 5), path, 1)
    assert text_index.search_index(spark, path, "same").count() == 4


def test_alerts_are_found_once_and_blocks_are_no_tasks(spark, tmp_path):
    path, met = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    rows = alerts(spark, 0, 1000)
    text_index.add_to_text_index(rows.mapInArrow(watched, rows.schema), path, 0, block_rows=10)
    assert met.value == 1000  # not once more for the count and once for the sample
    assert len(text_index.blocks_of(spark, path, "/same")) == 100
    postings = spark.read.parquet(f"{path}/data/batch=0/postings")
    # as the trigrams of each text, found by column expressions
    text = search.haystack(False)
    starts = F.sequence(F.lit(1), F.length("text") - 2)
    grams = F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(3)))))
    stored = spark.read.option("recursiveFileLookup", True).schema(rows.schema).parquet(f"{path}/data/batch=0/rows")
    expected = {r["gram"]: r["n"] for r in stored.select(text.alias("text")).select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    assert {r["gram"]: r["n"] for r in postings.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).collect()} == expected
    assert len(list((tmp_path / "index" / "data" / "batch=0").iterdir())) == 2  # rows and postings
