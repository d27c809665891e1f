"""Stages of the pipeline on odd tables, and executors that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from hedgewatch.llm.queries import table

ROOT = Path(corpus_pipeline.__file__).resolve().parent
CLASHING = ("_score", "_key", "_drawn", "_pii_found", "_pii_row", "_pii_drawn", "_PII_ROW_", "quality", "mark", "statistics", "component", "row", "size", "piece", "_rank")


@pytest.fixture(scope="module")
def clashing(spark, sf_dir):
    columns = [f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING]
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, "Mail bob@example.com or Mr John Smith, twice bob@example.com"),
                                 (900003, "Mail bob@example.com or Mr John Smith, twice bob@example.com")], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents")
    return docs.unionByName(odd, allowMissingColumns=True).selectExpr("*", *columns)


@pytest.mark.parametrize("at", [0, 1, 2])
def test_columns_of_any_name_pass(spark, sf_dir, clashing, at):
    given = {r["doc_id"]: r for r in clashing.collect()}
    kept = corpus_pipeline.STAGES[at][1](spark, clashing, sf_dir)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert rows
    for r in rows:
        for c in clashing.columns:
            if c not in ("text", "n_chars"):
                assert r[c] == given[r["doc_id"]][c]
    texts = {r["doc_id"]: r["text"] for r in rows}
    if at == 2:
        assert len(rows) == clashing.count() and "bob@" not in texts[900003] and texts[900001] is None and texts[900002] == ""
    if at == 1:
        assert sum(r["doc_id"] == 900003 for r in rows) == 1


def test_packing_of_odd_documents(spark, sf_dir, clashing):
    odd = clashing.where("doc_id > 900000")
    rows = corpus_pipeline.packing_stage(spark, odd, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == [900001, 900002, 900003, 900003]
    assert [r["length"] for r in sorted(rows, key=lambda r: r["doc_id"])][:2] == [1, 1]
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert corpus_pipeline.packing_stage(spark, odd.limit(0), sf_dir).count() == 0


def test_empty_tables_pass_all_stages(spark, sf_dir, clashing):
    none = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, none, sf_dir).count() == 0


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from hedgewatch.session import local_session
spark = local_session(2, shuffle_partitions=2, memory="2g")
spark.sparkContext.setLogLevel("ERROR")
queries = __spark_entry__.queries()
for name in {names!r}:
    print(name, queries[name](spark, {sf_dir!r}).count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path, sf_dir):
    """The package is on the driver's path only: set in the program, from another working directory."""
    names = ["op3_bpe_encoding", "op5_secret_scan", "op6_quality_classifier", "op11_suffix_automaton_decontamination",
             "op12_householder_whitening", "op13_bond_hard_negatives", "pipeline"]
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT), names=names, sf_dir=sf_dir))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[0] in names] == names
