"""Detection is compiled: the JVM interprets methods of more than 8,000 bytes, at several times the cost."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from hedgewatch.checks import runs
from hedgewatch.operators.detect import apply_rules
from hedgewatch.operators.reuse import HashedNgrams, embed_keys
from hedgewatch.plans.session import Options, detect


def test_methods_of_detection_are_small_enough_to_be_compiled(spark):
    raw = spark.range(3).selectExpr("id + 1 AS line_number", "concat('x', id) AS value", "'a' AS file_name")
    found = detect(spark, raw, "nginx", Options(scorer=runs._scorer))
    with contextlib.redirect_stdout(io.StringIO()) as text:
        found.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_rules_beyond_one_number_are_told_in_order(spark):
    """Of thirty rules, those of odd number match, with one name and type twice."""
    rules = spark.createDataFrame(
        [(i, f"r{i % 29}", i / 100, f"w{i}x" if i % 2 else "nothing", "any", f"t{i % 3}", "crs", None) for i in range(30)],
        "ordinal int, name string, score double, pattern string, field string, attack_type string, source string, needles array<string>")
    events = spark.createDataFrame([("/" + "".join(f"w{i}x" for i in range(30)), None), ("/plain", None)], "path string, query_string string")
    hit, none = apply_rules(events, rules).orderBy(F.desc("path")).collect()
    assert hit["matched_rules"] == [f"r{i % 29}" for i in range(1, 30, 2)] and hit["attack_types"] == ["t1", "t0", "t2"]
    assert (hit["rule_score"], hit["primary_type"], hit["matched"]) == (0.29, "t1", True)
    assert (none["matched_rules"], none["attack_types"], none["rule_score"], none["primary_type"], none["matched"]) == ([], [], 0.0, "", False)


@pytest.mark.parametrize("dims", [1, 16, 256])
def test_vectors_of_keys_are_the_called_embedders(spark, dims):
    keys = ["", "a", "GET /aaaa?b=c ua=", "é" * 40, "GET /x?" + "q=1&" * 200]
    found = embed_keys(spark.createDataFrame([(k,) for k in keys], "canonical_key string"), HashedNgrams(dims))
    for key, vector in found.select("canonical_key", "embedding").collect():
        called = HashedNgrams(dims)()([key])[0].astype("float64")
        assert len(vector) == dims and vector == pytest.approx(list(called / (called @ called) ** 0.5), abs=1e-6)


def test_lines_of_a_log_folder_are_made_without_a_shuffle_of_lines(spark, tmp_path):
    spark.createDataFrame([(e, e % 7) for e in (5, 3, 4, 3, 0)], "event_id long, user_id long").selectExpr(
        "event_id", "user_id", "'view' AS event_type", "1.5D AS value", "TIMESTAMP_NTZ '2024-01-02 03:04:05' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    folder = runs._log_folder(spark, str(tmp_path))
    lines = [r["value"] for r in spark.read.text(folder).select("value", "_metadata.file_name").orderBy("file_name").collect()]
    made = runs.inputs.raw_lines(spark, str(tmp_path))
    assert lines == [r["value"] for r in made.orderBy("line_number").collect()] and len(lines) == 5
