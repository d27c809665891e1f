"""Manifests: which folders make up a table as of a batch.

A batch writes its folders first and its manifest last; readers follow the newest manifest, so a batch is there whole or
not at all. A retried batch starts from the manifest before it and replaces its own folders and manifest. Folders that no
kept manifest names are removed when a batch is committed.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from hedgewatch.sources.files import listing, read_text, remove, write_text

#: Manifests that stay readable: that of the last batch, and the one a retry of it starts from.
KEPT = 2


def batches(spark: SparkSession, table: str) -> list[int]:
    """Committed batches whose manifests are kept, in order."""
    return sorted(int(name[:-5]) for name, _, regular in listing(spark, f"{table}/manifest") if regular and name.endswith(".json"))


def read_manifest(spark: SparkSession, table: str, before: int | None = None) -> dict | None:
    """The manifest of the last batch (before batch ``before``); None if there is none."""
    kept = batches(spark, table)
    past = [n for n in kept if before is None or n < before]
    if past:
        return json.loads(read_text(spark, f"{table}/manifest/{past[-1]}.json"))
    if kept and json.loads(read_text(spark, f"{table}/manifest/{kept[0]}.json"))["earlier"]:
        raise LookupError(f"{table} before batch {before} is no longer kept")
    return None


def commit(spark: SparkSession, table: str, batch: int, content: dict, folders: set[str], base: dict | None) -> None:
    """Make ``content`` the table as of ``batch``. ``folders`` are those it names, relative to the table; others go, unless the
    manifest it started from names them."""
    write_text(spark, f"{table}/manifest/{batch}.json", json.dumps(
        {"batch": batch, "earlier": base is not None, "folders": sorted(folders), **content}))
    committed = batches(spark, table)
    for n in [n for n in committed if n <= batch][:-KEPT] + [n for n in committed if n > batch]:
        remove(spark, f"{table}/manifest/{n}.json")
    named = folders | set(base["folders"] if base else ())
    for n in batches(spark, table):
        named |= set(json.loads(read_text(spark, f"{table}/manifest/{n}.json"))["folders"])
    for name, full, regular in listing(spark, f"{table}/data"):
        if regular:
            continue
        own = {f for f in named if f == f"data/{name}" or f.startswith(f"data/{name}/")}
        if not own:
            remove(spark, full)
        elif f"data/{name}" not in own:
            for inner, path, _ in listing(spark, full):
                if f"data/{name}/{inner}" not in own and "=" in inner:
                    remove(spark, path)
