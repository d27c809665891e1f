"""CVE indicator paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.session import broadcast_up_to

ENTRIES = "map<string, struct<indicator_paths:array<string>, paths:array<string>>>"
MAX_BROADCAST_PATHS = 1_000_000


def flatten_indicators(documents: DataFrame, column: str = "value") -> DataFrame:
    """Distinct paths of ``{cve: {indicator_paths | paths: [...]}}`` documents."""
    entries = documents.select(F.explode(F.map_values(F.from_json(column, ENTRIES))).alias("e"))
    paths = F.coalesce("e.indicator_paths", "e.paths")
    return entries.select(F.explode(paths).alias("path")).distinct()


def cve_indicators(spark: SparkSession, path: str) -> DataFrame:
    return flatten_indicators(spark.read.text(path, wholetext=True))


def match_cve(access_log: DataFrame, indicators: DataFrame) -> DataFrame:
    """Events whose path is an indicator path."""
    return access_log.join(broadcast_up_to(indicators, MAX_BROADCAST_PATHS), "path", "left_semi")
