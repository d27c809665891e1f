"""Search, statistics and metrics: registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.checks import inputs
from hedgewatch.checks.registry import register
from hedgewatch.checks.sql import LATENCY, score_severity, severity_name, statement
from hedgewatch.operators import alerts as alert_ops
from hedgewatch.operators import metrics, rank_index, search, text_index
from hedgewatch.session import checkpoint_dir

_READ = f"coalesce({severity_name('severity')}, {severity_name('v_severity')}, {score_severity('merged_score')})"


def _list(column: str) -> str:
    return f"CASE WHEN len({column}) > 0 THEN '[''' || array_to_string({column}, ''', ''') || ''']' END"


def _haystack(dashboard: bool) -> str:
    text = ["line_number::VARCHAR", *[f"nullif({c}, '')" for c in ("source_ip", "method", "path", "query_string")],
            "status_code::VARCHAR", "nullif(user_agent, '')", "nullif(raw_line, '')"]
    rules, types, cves = (f"array_to_string({c}, ',')" if dashboard else _list(c)
                          for c in ("matched_rules", "attack_types", "v_cves"))
    text += [rules, types]
    if not dashboard:
        text += ["nullif(severity, '')"]
    text += ["nullif(v_attack_type, '')"]
    if not dashboard:
        text += ["nullif(v_severity, '')"]
    text += ["nullif(v_explanation, '')", cves]
    return f"lower(concat_ws(' ', {', '.join(text)}))"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.alerts(spark, sf_dir)


@register("search_by_severity", statement(
    f"SELECT line_number FROM alerts WHERE {_READ} IN ('critical', 'low')", "alerts"))
def search_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_alerts(_alerts(spark, sf_dir), severity=["critical", "low"]).select("line_number")


@register("search_by_attack_type", statement(
    "SELECT line_number FROM alerts WHERE coalesce(v_attack_type, 'unknown') IN ('unknown', 'XSS')", "alerts"))
def search_by_attack_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_alerts(_alerts(spark, sf_dir), attack_type=["unknown", "XSS"]).select("line_number")


@register("search_by_address", statement(
    "SELECT line_number FROM alerts WHERE contains(lower(source_ip), '.12')", "alerts"))
def search_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_alerts(_alerts(spark, sf_dir), ip=".12").select("line_number")


@register("search_free_text", statement(
    f"SELECT line_number FROM alerts WHERE contains({_haystack(False)}, '''dir_scan'', ''scanner')", "alerts"))
def search_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that only occurs in the list notation of two rules in a row."""
    return search.filter_alerts(_alerts(spark, sf_dir), search="'DIR_SCAN', 'scanner").select("line_number")


@register("search_free_text_dashboard", statement(
    f"SELECT line_number FROM alerts WHERE contains({_haystack(True)}, 'sqli_union_or_boolean,s')", "alerts"))
def search_free_text_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_alerts(_alerts(spark, sf_dir), search="sqli_union_or_boolean,S", dashboard=True).select("line_number")


@register("search_text_index", statement(
    f"""SELECT 'rare' AS searched, line_number FROM alerts WHERE contains({_haystack(False)}, 'model=1')
    UNION ALL SELECT 'often', line_number FROM alerts WHERE contains({_haystack(False)}, '''dir_scan'', ''scanner')
    UNION ALL SELECT 'short', line_number FROM alerts WHERE contains({_haystack(False)}, '=9')
    UNION ALL SELECT 'filtered', line_number FROM alerts WHERE contains({_haystack(False)}, 'etc/shadow') AND {_READ} IN ('high', 'medium')""",
    "alerts"))
def search_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches through the trigram postings of alerts added in two batches."""
    path = f"{checkpoint_dir(spark)}/text-index-{uuid.uuid4()}"
    found = _alerts(spark, sf_dir)
    text_index.add_to_text_index(found.where("NOT cache_hit"), path, 0, block_rows=2000)
    text_index.add_to_text_index(found.where("cache_hit"), path, 1, block_rows=2000)
    searches = {"rare": ("model=1", None), "often": ("'DIR_SCAN', 'scanner", None), "short": ("=9", None),
                "filtered": ("etc/shadow", ["high", "medium"])}
    out = None
    for name, (text, severity) in searches.items():
        rows = text_index.search_index(spark, path, text, severity).select(F.lit(name).alias("searched"), "line_number")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("search_text_in_conversations", """
    SELECT conv_id, count(*) AS turns FROM conversations
    WHERE contains(lower(concat_ws(' ', nullif(role, ''), nullif(text, ''))), 'the') GROUP BY conv_id""")
def search_text_in_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substring search over a given text table, whole texts."""
    rows = inputs.table(spark, sf_dir, "conversations")
    text = F.lower(F.concat_ws(" ", F.nullif("role", F.lit("")), F.nullif("text", F.lit(""))))
    return rows.filter(F.contains(text, F.lit("the"))).groupBy("conv_id").agg(F.count("*").alias("turns"))


def _page(order: str, page: int, size: int, where: str = "TRUE") -> str:
    return statement(
        f"""SELECT rank, line_number, "timestamp", round(merged_score, 6) AS merged_score FROM (
          SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM alerts WHERE {where})
        WHERE rank > {(page - 1) * size} AND rank <= {page * size}""", "alerts")


def _shown(page: DataFrame) -> DataFrame:
    return page.select("rank", "line_number", "timestamp", F.round("merged_score", 6).alias("merged_score"))


@register("page_by_line", _page("line_number DESC", 1, 50))
def page_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.page_of(_alerts(spark, sf_dir)))


@register("page_by_score", _page("merged_score DESC, line_number", 3, 40))
def page_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.page_of(_alerts(spark, sf_dir), "merged_score", "desc", page=3, page_size=40))


@register("page_by_time", _page('"timestamp", line_number', 2, 200))
def page_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.page_of(_alerts(spark, sf_dir), "timestamp", "asc", page=2, page_size=500))


@register("search_page", _page("merged_score DESC, line_number", 1, 20, f"{_READ} IN ('high') AND contains(lower(source_ip), '10.')"))
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = search.search(_alerts(spark, sf_dir), severity=["high"], ip="10.", sort_by="merged_score", page_size=20)
    return _shown(page)


@register("last_page", statement(
    """SELECT line_number, merged_score, rank FROM (
      SELECT line_number, merged_score, row_number() OVER (ORDER BY merged_score DESC, line_number) AS rank, count(*) OVER () AS n FROM alerts)
    WHERE rank > (ceil(n / 50.0)::BIGINT - 1) * 50""", "alerts"))
def last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest page, from alerts stored in display order: it opens the ranges that it lies in."""
    path = f"{checkpoint_dir(spark)}/ranked-{uuid.uuid4()}"
    rank_index.build_rank_index(_alerts(spark, sf_dir), path, "merged_score", "desc", range_rows=1000)
    pages = search.totals(spark.read.parquet(f"{path}/rows"), 50).first()["total_pages"]
    return rank_index.page_from_index(spark, path, pages, 50).select("line_number", "merged_score", "rank")


@register("search_totals", statement(
    f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total_pages FROM alerts WHERE {_READ} IN ('high')", "alerts"))
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_alerts(spark, sf_dir), severity=["high"], page_size=20)[1]


@register("exported_page", statement(
    """SELECT line_number, path, severity FROM alerts ORDER BY line_number DESC LIMIT 50""", "alerts"))
def exported_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current page written as JSON and read back."""
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4()}"
    alert_ops.export_alerts(search.page_of(_alerts(spark, sf_dir)), path)
    return spark.read.schema("line_number bigint, path string, severity string").json(path)


@register("severity_counts", statement(
    f"""SELECT d.severity, count(a.severity) AS alerts FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('noimpact')) AS d(severity)
    LEFT JOIN (SELECT {_READ} AS severity FROM alerts) a ON a.severity = d.severity GROUP BY d.severity""", "alerts"))
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.severity_counts(_alerts(spark, sf_dir))


@register("distinct_attack_types", statement(
    "SELECT DISTINCT coalesce(nullif(v_attack_type, ''), 'unknown') AS attack_type FROM alerts", "alerts"))
def distinct_attack_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.attack_types(_alerts(spark, sf_dir))


@register("page_date_range", statement(
    """SELECT arg_max("timestamp", rank) AS first, arg_min("timestamp", rank) AS last FROM (
      SELECT "timestamp", row_number() OVER (ORDER BY merged_score DESC, line_number) AS rank FROM alerts) WHERE rank <= 50""", "alerts"))
def page_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.date_range(search.page_of(_alerts(spark, sf_dir), "merged_score"))


# arrivals: every alert once, those of views and clicks again under a null line
@register("latest_wins_upsert", statement(
    """SELECT alert_key, arg_max(severity, arrival) AS severity, max(arrival) AS arrival FROM (
      SELECT 'line:' || line_number AS alert_key, severity, line_number AS arrival FROM alerts
      UNION ALL SELECT 'line:' || line_number, 'medium', line_number + 100000000 FROM alerts WHERE cache_hit
      UNION ALL SELECT coalesce("timestamp", '') || '|' || coalesce(source_ip, '') || '|' || '/' || '|' || '0.5', severity, line_number
        FROM alerts WHERE NOT cache_hit) GROUP BY alert_key""", "alerts"))
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).select("line_number", "timestamp", "source_ip", "path", "merged_score", "severity", "cache_hit")
    first = alerts.withColumn("arrival", F.col("line_number"))
    again = first.filter("cache_hit").withColumns({"severity": F.lit("medium"), "arrival": F.col("arrival") + 100000000})
    unnumbered = first.filter("NOT cache_hit").withColumns({
        "line_number": F.lit(None).cast("bigint"), "path": F.lit("/"), "merged_score": F.lit(0.5)})
    arrivals = first.unionByName(again).unionByName(unnumbered)
    return search.upsert(arrivals).select("alert_key", "severity", "arrival")


@register("latest_session", statement(
    """SELECT coalesce((SELECT arg_min(session_id, created_at) FROM sessions WHERE status = 'processing'),
      (SELECT arg_max(session_id, created_at) FROM sessions)) AS session_id""", "sessions"))
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest_session(inputs.sessions(spark, sf_dir))


@register("session_summary", statement(
    """SELECT s.session_id, status, progress, total_lines, count(a.session_id) AS total_alerts
    FROM sessions s LEFT JOIN alerts a ON a.session_id = s.session_id GROUP BY ALL""", "sessions", "alerts"))
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.session_summary(inputs.sessions(spark, sf_dir), _alerts(spark, sf_dir)).drop("created_at")


@register("session_alerts", statement(
    "SELECT line_number, severity FROM alerts WHERE session_id = 's7'", "alerts"))
def session_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.session_alerts(_alerts(spark, sf_dir), "s7").select("line_number", "severity")


# --- metrics --------------------------------------------------------------------

_ALERT_TOTALS = """count(*) AS total_alerts, count(*) FILTER (WHERE cache_hit) AS cache_hits,
  sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens,
  count(*) FILTER (WHERE NOT cache_hit) AS total_llm_calls,
  round(count(*) FILTER (WHERE cache_hit)::DOUBLE / count(*), 3) AS cache_hit_rate"""
_TIMES = f"""count(*) AS total_lines, round(sum({LATENCY}) / 1000.0::DOUBLE, 2) AS total_time_s,
  round(count(*) / (sum({LATENCY}) / 1000.0::DOUBLE), 1) AS throughput_ev_s, round(avg({LATENCY}), 2) AS latency_avg_ms"""
_P95 = f"(SELECT round(list_sort(list({LATENCY}))[floor(count(*) * 0.95)::BIGINT + 1], 2) FROM lines)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("line_number"), inputs.latency().alias("latency_ms"))


@register("alert_totals", statement(f"SELECT {_ALERT_TOTALS} FROM alerts", "alerts"))
def alert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alert_totals(_alerts(spark, sf_dir))


@register("hit_types", statement(
    "SELECT coalesce(cache_hit_type, 'unknown') AS hit_type, count(*) AS hits FROM alerts WHERE cache_hit GROUP BY 1", "alerts"))
def hit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_types(_alerts(spark, sf_dir))


@register("latency_totals", statement(f"SELECT {_TIMES} FROM lines", "lines"))
def latency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_totals(_lines(spark, sf_dir))


@register("latency_p95", statement(f"SELECT {_P95} AS latency_p95_ms", "lines"))
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_p95(_lines(spark, sf_dir))


@register("progress_marks", statement(
    """SELECT line_number AS processed, total FROM (SELECT line_number, (SELECT count(*) FROM lines) AS total FROM lines)
    WHERE line_number % greatest(1, total // 100) = 0 OR line_number = total""", "lines"))
def progress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.progress(_lines(spark, sf_dir))


@register("session_metrics", statement(
    f"""SELECT t.*, {_P95} AS latency_p95_ms, a.*,
      (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT coalesce(cache_hit_type, 'unknown') || '=' || count(*) AS h
        FROM alerts WHERE cache_hit GROUP BY cache_hit_type)) AS cache_hit_types
    FROM (SELECT {_TIMES} FROM lines) t, (SELECT {_ALERT_TOTALS} FROM alerts) a""", "lines", "alerts"))
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = metrics.session_metrics(_lines(spark, sf_dir), _alerts(spark, sf_dir))
    types = F.array_join(F.array_sort(F.transform(
        F.map_entries("cache_hit_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return whole.withColumn("cache_hit_types", types)
