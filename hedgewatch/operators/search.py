"""Search, sort, paging and the statistics shown next to a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.severity import alert_severity
from hedgewatch.functions.text import list_literal, non_empty


def read_severity() -> Column:
    return alert_severity(F.col("severity"), F.col("analysis.severity"), F.col("merged_score"))


def read_attack_type() -> Column:
    return F.coalesce("analysis.attack_type", F.lit("unknown"))


def haystack(dashboard: bool) -> Column:
    """Searched text: the fields that have a value, joined by blanks. The dashboard
    variant has no severities and shows lists comma-separated."""
    def number(name: str) -> Column:
        value = F.col(name)
        return F.when(value != 0, value.cast("string"))

    def items(c: Column) -> Column:
        if dashboard:  # an empty list counts as a value there and adds nothing but a blank
            return F.array_join(c, ",")
        return F.when(F.size(c) > 0, list_literal(c))

    text = [
        number("line_number"), *[non_empty(F.col(c)) for c in ("source_ip", "method", "path", "query_string")],
        number("status_code"), non_empty(F.col("user_agent")), non_empty(F.col("raw_line")),
        items(F.col("matched_rules")), items(F.col("attack_types")),
    ]
    analysis = {c: non_empty(F.col(f"analysis.{c}")) for c in ("attack_type", "severity", "explanation")}
    if not dashboard:
        text += [non_empty(F.col("severity")), analysis["attack_type"], analysis["severity"]]
    else:
        text += [analysis["attack_type"]]
    text += [analysis["explanation"], items(F.col("analysis.cve_refs"))]
    return F.lower(F.concat_ws(" ", *text))


def filter_alerts(alerts: DataFrame, severity: list[str] | None = None,
                  attack_type: list[str] | None = None, ip: str | None = None,
                  search: str | None = None, dashboard: bool = False) -> DataFrame:
    """Alerts that pass every given filter; an empty filter passes all."""
    if severity:
        alerts = alerts.filter(read_severity().isin(*severity))
    if attack_type:
        alerts = alerts.filter(read_attack_type().isin(*attack_type))
    if ip:
        alerts = alerts.filter(F.contains(F.lower(F.coalesce("source_ip", F.lit(""))), F.lit(ip.lower())))
    if search:
        alerts = alerts.filter(F.contains(haystack(dashboard), F.lit(search.lower())))
    return alerts


def sort_columns(sort_by: str = "line_number", sort_order: str = "desc") -> list[Column]:
    """Sort by score, by time (its ISO text) or by line. Equal rows stay in line
    order, ascending, in both directions."""
    name = sort_by if sort_by in ("merged_score", "timestamp") else "line_number"
    column = F.col(name).desc() if sort_order == "desc" else F.col(name).asc()
    return [column] if name == "line_number" else [column, F.col("line_number").asc()]


def page_of(alerts: DataFrame, sort_by: str = "line_number", sort_order: str = "desc",
            page: int = 1, page_size: int = config.PAGE_SIZE_DEFAULT) -> DataFrame:
    """One page in display order, numbered by ``rank`` within the result. A top-k
    plan: every task keeps at most ``page * page_size`` rows."""
    page, page_size = max(1, page), max(1, min(page_size, config.PAGE_SIZE_MAX))
    start = (page - 1) * page_size
    order = sort_columns(sort_by, sort_order)
    rows = alerts.orderBy(*order).offset(start).limit(page_size)
    # the window runs over one page
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + start)


def totals(alerts: DataFrame, page_size: int = config.PAGE_SIZE_DEFAULT) -> DataFrame:
    """One row: ``total`` and ``total_pages``."""
    page_size = max(1, min(page_size, config.PAGE_SIZE_MAX))
    return alerts.agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / page_size)))


def search(alerts: DataFrame, severity: list[str] | None = None,
           attack_type: list[str] | None = None, ip: str | None = None, search: str | None = None,
           sort_by: str = "line_number", sort_order: str = "desc", page: int = 1,
           page_size: int = config.PAGE_SIZE_DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(page, totals)`` of the alerts that pass the filters."""
    found = filter_alerts(alerts, severity, attack_type, ip, search)
    return page_of(found, sort_by, sort_order, page, page_size), totals(found, page_size)


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per severity, zeros included."""
    spark = alerts.sparkSession
    domain = spark.createDataFrame([(s,) for s in (*config.SEVERITIES, "noimpact")], "severity string")
    counted = alerts.groupBy(read_severity().alias("severity")).agg(F.count("*").alias("alerts"))
    return domain.join(counted, "severity", "left").select(
        "severity", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def attack_types(alerts: DataFrame) -> DataFrame:
    """Distinct attack types, sorted; empty ones count as ``unknown`` here."""
    kind = F.coalesce(non_empty(F.col("analysis.attack_type")), F.lit("unknown"))
    return alerts.select(kind.alias("attack_type")).distinct().orderBy("attack_type")


def date_range(page: DataFrame) -> DataFrame:
    """First and last timestamp of a page: those of its last and first row in
    display order."""
    with_time = page.filter(F.coalesce("timestamp", F.lit("")) != "")
    return with_time.agg(F.max_by("timestamp", "rank").alias("first"),
                         F.min_by("timestamp", "rank").alias("last"))


def alert_key() -> Column:
    fallback = F.concat_ws(
        "|", F.coalesce("timestamp", F.lit("")), F.coalesce("source_ip", F.lit("")),
        F.coalesce("path", F.lit("")), F.coalesce(F.col("merged_score").cast("string"), F.lit("undefined")))
    return F.coalesce(F.concat(F.lit("line:"), F.col("line_number").cast("string")), fallback)


def upsert(arrivals: DataFrame, order: str = "arrival") -> DataFrame:
    """The newest row per alert key. An aggregate that combines map-side, so a key
    that arrives over and over is cheap."""
    rows = arrivals.withColumn("alert_key", alert_key())
    newest = rows.groupBy("alert_key").agg(F.max_by(F.struct(*arrivals.columns), order).alias("r"))
    return newest.select("alert_key", "r.*")


def latest_session(sessions: DataFrame) -> DataFrame:
    """The session to show: the oldest one still processing, else the newest."""
    running = F.col("status") == "processing"
    return sessions.agg(F.coalesce(
        F.min_by(F.when(running, F.col("session_id")), F.when(running, F.col("created_at"))),
        F.max_by("session_id", F.coalesce("created_at", F.lit(0.0))),
    ).alias("session_id"))


def session_summary(sessions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sessions with their alert counts (counted before the join)."""
    counts = alerts.groupBy("session_id").agg(F.count("*").alias("total_alerts"))
    return sessions.join(counts, "session_id", "left").withColumn(
        "total_alerts", F.coalesce("total_alerts", F.lit(0)))


def session_alerts(alerts: DataFrame, session_id: str, sessions: DataFrame | None = None) -> DataFrame:
    """Alerts of one session; with ``sessions`` given, an unknown id is an error."""
    if sessions is not None and sessions.filter(F.col("session_id") == session_id).isEmpty():
        raise LookupError("Session not found")
    return alerts.filter(F.col("session_id") == session_id)
