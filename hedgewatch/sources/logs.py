"""Log directory and single-file scans with global line numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgewatch.functions.text import percent_decode_sql, strip_sql
from hedgewatch.session import broadcast_up_to, cut_lineage
from hedgewatch.sources.files import is_file, listing

# Line ends other than the newline family, at which text is also cut.
_OTHER_BREAKS = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Splits up to which their line offsets are broadcast (about 150 bytes each);
# beyond it the optimizer picks the join. A million splits is ~100 TB of text.
MAX_BROADCAST_SPLITS = 1_000_000


def log_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(name, full path)`` of the regular files directly in ``path`` whose names
    do not start with a dot, sorted by name."""
    return [(name, full) for name, full, regular in listing(spark, path)
            if regular and not name.startswith(".")]


def refuse_hidden(spark: SparkSession, path: str, underscore: str = "error") -> None:
    """Raise for log files that Spark's file sources would leave out without a word: in a directory names with a
    leading underscore (a leading dot means "no log" there), of a single file both. ``underscore='skip'`` lets them be left out."""
    if is_file(spark, path):
        unseen = [name for name in (path.rstrip("/").rpartition("/")[2],) if name.startswith(("_", "."))]
    else:
        unseen = [name for name, _ in log_files(spark, path) if name.startswith("_")] if underscore == "error" else []
    if unseen:
        raise ValueError(f"Spark's file sources never read such names: {unseen[:5]}; "
                         "rename them, or pass underscore='skip' to leave those of a directory out")


def _scan(spark: SparkSession, path: str, underscore: str) -> DataFrame | None:
    """``value`` plus the split each line came from; None without any file."""
    refuse_hidden(spark, path, underscore)
    if is_file(spark, path):
        reader = spark.read.text(path)
    else:
        children = listing(spark, path)
        files = [c for c in children if c[2] and not c[0].startswith((".", "_"))]
        if not files:
            return None
        # A directory scan would also descend into key=value folders; list the
        # files where there is one.
        plain = not any("=" in name for name, _, regular in children if not regular)
        reader = spark.read.text(path if plain else [full for _, full, _ in files])
    return reader.select(
        "value",
        F.expr(percent_decode_sql("_metadata.file_name")).alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def lines_of(scan: DataFrame, split_unicode_breaks: bool) -> DataFrame:
    """Valid UTF-8, non-blank lines of a scan."""
    text = scan.withColumn("value", F.make_valid_utf8("value"))
    if split_unicode_breaks:
        parts = F.when(F.col("value").rlike(_OTHER_BREAKS), F.split("value", _OTHER_BREAKS)).otherwise(
            F.array("value"))
        text = text.select(*[c for c in text.columns if c != "value"], F.explode(parts).alias("value"))
    return text.filter(f"{strip_sql('value')} <> ''")


@dataclass
class LogScan:
    """``lines(line_number, value, file_name)`` and ``splits(file_name, lines, ...)``,
    the already counted splits they come from."""
    lines: DataFrame
    splits: DataFrame

    def total(self) -> int:
        return self.splits.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]

    def files(self) -> list[str]:
        """Names of the files that contributed lines, in order."""
        named = self.splits.select("file_name").distinct().orderBy("file_name")
        return [r["file_name"] for r in named.collect()]


def read_logs(spark: SparkSession, path: str, split_unicode_breaks: bool | None = None,
              underscore: str = "error") -> DataFrame:
    """``raw_lines(line_number, value, file_name)`` of a directory or one file; see
    ``scan_logs``."""
    return scan_logs(spark, path, split_unicode_breaks, underscore).lines


def scan_logs(spark: SparkSession, path: str, split_unicode_breaks: bool | None = None,
              underscore: str = "error") -> LogScan:
    """Lines of a directory or one file and their counts per split.

    Lines are numbered from 1 over the files in name order. The numbers need no
    shuffle of the lines: a first pass counts lines per split (a tiny table), a
    prefix sum over that table gives each split's offset, and the second pass
    adds the position within the split. A directory is also cut at the Unicode
    line ends, a single file only at newlines, unless said otherwise. Names with
    a leading underscore, which Spark cannot read, raise an error by default.
    """
    if split_unicode_breaks is None:
        split_unicode_breaks = not is_file(spark, path)
    # Both passes must see the same splits, whatever executors come and go.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    scan = _scan(spark, path, underscore)
    if scan is None:
        return LogScan(
            spark.createDataFrame([], "line_number bigint, value string, file_name string"),
            spark.createDataFrame([], "file_name string, block_start bigint, lines bigint, first_row bigint"))
    return number_lines(lines_of(scan, split_unicode_breaks))


def split_counts(lines: DataFrame) -> DataFrame:
    """Lines and first row id per split."""
    return lines.groupBy("file_name", "block_start").agg(
        F.count("*").alias("lines"), F.min("row_id").alias("first_row"))


def number_lines(lines: DataFrame) -> LogScan:
    """Global line numbers for ``lines(value, file_name, block_start)``.

    Row ids rise by one within a task, and a split is read by one task without
    gaps, so a row's position in its split is its id minus the split's first.
    """
    tagged = lines.withColumn("row_id", F.monotonically_increasing_id())
    counts = cut_lineage(split_counts(tagged))  # one counting pass, tiny result
    # Two levels keep each window small: splits of one file, then files.
    in_file = Window.partitionBy("file_name").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1)
    over_files = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file_name").agg(F.sum("lines").alias("lines")).select(
        "file_name", F.coalesce(F.sum("lines").over(over_files), F.lit(0)).alias("before_file"))
    offsets = counts.withColumn(
        "before_split", F.coalesce(F.sum("lines").over(in_file), F.lit(0))
    ).join(files, "file_name").select(
        "file_name", "block_start", "first_row",
        (F.col("before_file") + F.col("before_split")).alias("offset"))
    joined = tagged.join(broadcast_up_to(offsets, MAX_BROADCAST_SPLITS),
                         ["file_name", "block_start"], "left")
    number: Column = F.col("offset") + F.col("row_id") - F.col("first_row") + 1
    numbered = joined.select(
        F.coalesce(number, F.raise_error(F.lit("the input changed while it was being numbered"))
                   .cast("bigint")).alias("line_number"),
        "value", "file_name")
    return LogScan(numbered, counts)


def first_line(spark: SparkSession, path: str, split_unicode_breaks: bool = True) -> str | None:
    """The first non-blank line in file-name order; reads only the head of the
    first file that has one."""
    files = [path] if is_file(spark, path) else [full for name, full in log_files(spark, path) if not name.startswith("_")]
    for full in files:
        head = lines_of(spark.read.text(full), split_unicode_breaks).select("value").take(1)
        if head:
            return head[0]["value"]
    return None


def parse_file(spark: SparkSession, path: str, source: str | None = None,
               max_lines: int | None = None) -> DataFrame:
    """The access log of one file. ``max_lines`` counts parsed rows."""
    from hedgewatch.operators.ingest import SOURCES, ingest, source_of_line

    if not is_file(spark, path):
        raise FileNotFoundError(f"Log file not found: {path}")
    if source is not None and source not in SOURCES:
        raise ValueError(f"Unsupported log source: {source}")
    if source is None:  # from the head of the file, not by another scan
        head = first_line(spark, path, split_unicode_breaks=False)
        source = source_of_line(spark, head)
    return ingest(read_logs(spark, path), source, max_rows=max_lines)[0]
