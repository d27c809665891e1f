"""Lines in, normalized access log and rejects out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.functions import logline as ll
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.text import decode_columns, strip_sql

SAMPLE_LINES = 10
SOURCES = ("nginx", "apache")


def detect_source(raw_lines: DataFrame, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """One row ``source``: the format of the first non-blank line among the first
    ``sample_lines`` lines, ``nginx`` if there is none."""
    first = (
        raw_lines.filter(F.col("line_number") <= sample_lines)
        .filter(f"{strip_sql('value')} <> ''")
        .agg(F.min_by("value", "line_number").alias("value"))
    )
    return first.selectExpr(f"{_source_of('value')} AS source")


def _source_of(line: str) -> str:
    return f"CASE WHEN {line} IS NULL OR {ll.looks_like_nginx(line)} THEN 'nginx' ELSE 'apache' END"


def source_of_line(spark: SparkSession, line: str | None) -> str:
    """The format of one line; ``nginx`` without one."""
    probe = spark.createDataFrame([(line,)], "value string")
    return probe.selectExpr(_source_of("value")).first()[0]


def split_fields(raw_lines: DataFrame, source: str = "auto") -> DataFrame:
    """``raw_lines`` plus ``raw_line`` (stripped), ``source`` and ``fields``.

    ``source`` is ``auto`` (one format for all lines, from the first of them),
    ``per_line``, ``nginx`` or ``apache``.
    """
    if source == "auto":
        format_of = detect_source(raw_lines).scalar()
    elif source == "per_line":
        format_of = F.expr(_source_of("raw_line"))
    elif source in SOURCES:
        format_of = F.lit(source)
    else:
        raise ValueError(f"Unsupported log source: {source}")
    return (
        raw_lines.withColumn("raw_line", F.expr(strip_sql("value")))
        .withColumn("source", format_of)
        .withColumn("fields", F.expr(ll.split_line("raw_line", "source")))
    )


def _typed(fields: DataFrame) -> DataFrame:
    """Typed columns from ``fields``; ``parsed`` says whether the line is valid."""
    f = {name: f"get(fields, {i})" for i, name in enumerate(ll.FIELDS)}
    # times are fenced off: with all other columns they would be one method that is too large for the JVM to compile
    timed = with_columns_once(fields.selectExpr("*", f"{ll.time_parts(f['time'])} AS time_parts"), {"ts_iso": F.expr(ll.iso_time("time_parts"))})
    return timed.selectExpr(
        "*",
        f"{ll.parse_time('time_parts', 'ts_iso')} AS timestamp",
        f"{ll.parse_size(f['size'])} AS response_size",
        f"try_cast({f['status']} AS INT) AS status_code",
    ).selectExpr(
        "*",
        f"size(fields) = {len(ll.FIELDS)} AND timestamp IS NOT NULL AND response_size IS NOT NULL "
        "AND coalesce(status_code BETWEEN 100 AND 599, false) AS parsed",
        f"{f['ip']} AS source_ip",
        f"upper({f['method']}) AS method",
        f"{ll.uri_path(f['uri'])} AS path",
        f"{ll.uri_query(f['uri'])} AS query_string",
        f"{ll.optional(f['agent'], 'source')} AS user_agent",
        f"{ll.optional(f['referer'], 'source')} AS referer",
        "CAST(NULL AS STRING) AS content",
    )


LOG_COLUMNS = (
    "line_number", "timestamp", "ts_iso", "source_ip", "method", "path", "status_code",
    "source", "user_agent", "response_size", "query_string", "content", "referer", "raw_line",
)


def parse(raw_lines: DataFrame, source: str = "auto") -> DataFrame:
    """The normalized access log: one row per valid line. No shuffle."""
    typed = _typed(split_fields(raw_lines, source)).drop("value", "fields", "time_parts")
    decoded = decode_columns(typed, ["path", "query_string"], times=2)
    computed = [c for c in decoded.columns if c not in raw_lines.columns and c != "parsed"]
    once = with_columns_once(decoded, {c: F.col(c) for c in computed}, keep=F.col("parsed"))
    extra = [c for c in raw_lines.columns if c not in ("value", *LOG_COLUMNS)]
    return once.select(*LOG_COLUMNS, *extra)


def rejects(raw_lines: DataFrame, source: str = "auto") -> DataFrame:
    """Lines that are not valid log lines, blank ones aside."""
    typed = _typed(split_fields(raw_lines, source))
    return with_columns_once(
        typed, {"raw": F.col("raw_line")}, keep=~F.col("parsed") & (F.col("raw_line") != "")
    ).select("line_number", "raw")


def ingest(raw_lines: DataFrame, source: str = "auto",
           max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(access_log, rejects)``. ``max_rows`` keeps the first valid rows in line
    order and counts valid rows, not input lines."""
    log = parse(raw_lines, source)
    if max_rows is not None:
        log = log.orderBy("line_number").limit(max_rows)
    return log, rejects(raw_lines, source)


def normalize(events: DataFrame) -> DataFrame:
    """Structured events (already in access-log columns, possibly with
    ``content``) brought to the same form: texts decoded twice, method in upper
    case, rows with an invalid status dropped."""
    decoded = decode_columns(
        events.withColumns({"method": F.upper("method"),
                            "status_code": F.col("status_code").try_cast("int")}),
        [c for c in ("path", "query_string", "content") if c in events.columns], times=2,
    )
    return with_columns_once(
        decoded, {c: F.col(c) for c in ("path", "query_string", "content") if c in events.columns},
        keep=F.col("status_code").between(100, 599),
    )


def parse_rate(raw_lines: DataFrame, source: str = "auto") -> DataFrame:
    """One row: candidate lines (not blank, not ``#`` comments), parsed lines and
    their ratio."""
    typed = _typed(split_fields(raw_lines, source))
    candidate = (F.col("raw_line") != "") & ~F.startswith(F.col("raw_line"), F.lit("#"))
    counts = typed.agg(
        F.count_if(candidate).alias("candidates"),
        F.count_if(candidate & F.col("parsed")).alias("parsed"),
    )
    return counts.withColumn(
        "rate", F.when(F.col("candidates") > 0, F.col("parsed") / F.col("candidates")).otherwise(0.0)
    )
