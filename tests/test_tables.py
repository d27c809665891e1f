"""Tables that batches are added to: runs with filters, merged buckets, manifests."""

import random

import pytest
from pyspark.sql import functions as F

from hedgewatch.sources import keyed_runs, manifest, merge_table
from hedgewatch.sources.files import listing

SCHEMA = "name string, value long"


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def everything(spark, path, **kind):
    return dict(map(tuple, keyed_runs.read_all(spark, path, table_of(spark, []).schema, "name", **kind).collect()))


def folders(spark, path):
    return {name for name, _, regular in listing(spark, f"{path}/data") if not regular}


def test_fifty_batches_equal_one_aggregation(spark, tmp_path):
    path, draw, expected = str(tmp_path / "t"), random.Random(1), {}
    before = {}
    for batch in range(1, 51):
        rows = {f"k{draw.randrange(60)}": batch * 1000 + i for i in range(draw.randrange(6))}
        before, expected = expected, expected | rows
        keyed_runs.write_run(table_of(spark, list(rows.items())), path, "name", batch, buckets=4)
    assert everything(spark, path) == expected and everything(spark, path, before=50) == before
    runs = manifest.read_manifest(spark, path)["runs"]
    # 50 = 3 * 16 + 2: every tier has fewer runs than are merged
    assert [r["tier"] for r in runs] == [2, 2, 2, 0, 0]
    kept = {f.removeprefix("data/") for b in manifest.batches(spark, path) for f in manifest.read_manifest(spark, path, before=b + 1)["folders"]}
    assert folders(spark, path) == kept
    with pytest.raises(LookupError):
        everything(spark, path, before=40)


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(1, 5):  # the fourth is merged with those before it
        keyed_runs.write_run(table_of(spark, [("a", batch), (f"b{batch}", batch)]), path, "name", batch)
    first = everything(spark, path)
    keyed_runs.write_run(table_of(spark, [("a", 40)]), path, "name", 4)
    assert first["b4"] == 4 and everything(spark, path) == {"a": 40, "b1": 1, "b2": 2, "b3": 3}
    assert everything(spark, path, before=4) == {"a": 3, "b1": 1, "b2": 2, "b3": 3}


def test_a_batch_without_manifest_is_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed_runs.write_run(table_of(spark, [("a", 1)]), path, "name", 1)
    table_of(spark, [("a", 2)]).write.parquet(f"{path}/data/run=2-0/rows")  # lost before its manifest
    assert everything(spark, path) == {"a": 1}
    keyed_runs.write_run(table_of(spark, [("c", 3)]), path, "name", 2)
    assert everything(spark, path) == {"a": 1, "c": 3}


def test_lookups_open_what_may_hold_their_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(1, 4):
        keyed_runs.write_run(spark.range(200).selectExpr(f"concat('b{batch}-', id) AS name", "id AS value"), path, "name", batch)
    keys = table_of(spark, [("b2-17", 0), ("b2-17", 0), ("nowhere", 0), (None, 0)])
    opened = keyed_runs.folders_for(keys, path, "name")
    assert len(opened) <= 3 and [f.split("/")[1] for f in opened].count("run=2-0") >= 1
    kind = table_of(spark, []).schema
    found = keyed_runs.read_keys(keys, path, kind, "name")
    assert list(map(tuple, found.collect())) == [("b2-17", 17)]
    assert {f.rsplit("/", 2)[1] for f in found.inputFiles() if "/rows/" in f} <= {f.rsplit("/", 1)[1] for f in opened}
    # no key is ever missed, and few that are not there pass
    many = spark.range(3000).selectExpr("concat('b', 1 + id % 3, '-', id) AS name", "id AS value")
    assert keyed_runs.read_keys(many, path, kind, "name").count() == 200
    strangers = keyed_runs.folders_for(table_of(spark, [("x", 1), ("y", 2), ("z", 3)]), path, "name")
    assert len(strangers) <= 1
    assert keyed_runs.read_keys(keys, str(tmp_path / "none"), kind, "name").count() == 0


def test_merging_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")

    def newest(rows):
        return rows.groupBy("name").agg(F.max("value").alias("value"))

    merge_table.merge(table_of(spark, [(f"k{i}", i) for i in range(300)]), path, "name", 0, newest, buckets=8)
    first = manifest.read_manifest(spark, path)["named"]
    merge_table.merge(table_of(spark, [("k7", 1000), ("k7", 1001)]), path, "name", 1, newest)
    second = manifest.read_manifest(spark, path)["named"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    rows = dict(map(tuple, merge_table.read_merged(spark, path).select("name", "value").collect()))
    assert rows == {f"k{i}": 1001 if i == 7 else i for i in range(300)}
    merge_table.merge(table_of(spark, [("k7", 5), ("new", 1)]), path, "name", 1, newest)  # again, with other rows
    again = dict(map(tuple, merge_table.read_merged(spark, path).select("name", "value").collect()))
    assert again == {f"k{i}": i for i in range(300)} | {"new": 1}
    for batch in range(2, 5):
        merge_table.merge(table_of(spark, [("k7", 2000 + batch)]), path, "name", batch, newest)
    assert dict(map(tuple, merge_table.read_merged(spark, path).select("name", "value").collect()))["k7"] == 2004
    bucket = next(b for b in first if manifest.read_manifest(spark, path)["named"][b].startswith("data/batch=4"))
    # replaced versions go, but for the one that a retry starts from
    left = [b for b in range(5) if any(name == f"__bucket={bucket}" for name, _, _ in listing(spark, f"{path}/data/batch={b}"))]
    assert left == [3, 4]
    with pytest.raises(FileNotFoundError):
        merge_table.read_merged(spark, str(tmp_path / "none"))
