"""Alerts: building, read-side views and serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.severity import score_severity, severity_name
from hedgewatch.functions.text import lookup

CACHE_COLUMNS = {
    "cache_hit_type": "string", "cache_similarity": "double", "cached_attack_type": "string",
    "cache_decision_reason": "string", "cache_policy_mode": "string",
}
ALERT_COLUMNS = (
    "line_number", "timestamp", "source_ip", "method", "path", "query_string", "status_code",
    "user_agent", "raw_line", "merged_score", "rule_score", "ml_score", "severity", "cache_hit",
    *CACHE_COLUMNS, "analysis", "matched_rules", "attack_types",
    "input_tokens", "output_tokens", "ttft_ms",
)


def build_alerts(flagged: DataFrame) -> DataFrame:
    """Alerts from flagged events with their ``verdict``, ``cache_hit`` and, on a
    hit, the reuse columns.

    The verdict's evidence is always the rule engine's own, so ``matched_rules``
    and ``attack_types`` are the event's, on hits too. A reused verdict costs no
    tokens. ``timestamp`` is the ISO text in the original offset.
    """
    hit = F.col("cache_hit")
    columns = {c: (F.when(hit, F.col(c)) if c in flagged.columns else F.lit(None)).cast(t)
               for c, t in CACHE_COLUMNS.items()}
    extra = [c for c in ("session_id", "latency_ms") if c in flagged.columns]
    return with_columns_once(flagged, {
        "timestamp": F.col("ts_iso"),
        "analysis": F.col("verdict"),
        "severity": F.coalesce(severity_name(F.col("verdict.severity")),
                               score_severity(F.col("merged_score"))),
        "input_tokens": F.when(hit, F.lit(0)).otherwise(F.coalesce("verdict.input_tokens", F.lit(0))),
        "output_tokens": F.when(hit, F.lit(0)).otherwise(F.coalesce("verdict.output_tokens", F.lit(0))),
        "ttft_ms": F.when(~hit, F.col("verdict.ttft_ms")),
        **columns,
    }).select(*extra, *ALERT_COLUMNS)


def alerts_json(alerts: DataFrame) -> DataFrame:
    """``line_number`` and ``json``, one document per alert, nulls written out.
    Scores and similarity are rounded to four places; tokens are not part of it."""
    def four(name: str) -> Column:
        return F.round(name, 4).alias(name)

    fields = [
        F.col(c) if c not in ("merged_score", "rule_score", "ml_score", "cache_similarity") else four(c)
        for c in ALERT_COLUMNS if c not in ("input_tokens", "output_tokens", "ttft_ms")
    ]
    extra = [F.round("latency_ms", 2).alias("latency_ms")] if "latency_ms" in alerts.columns else []
    return alerts.select("line_number", F.to_json(
        F.struct(*fields, *extra), {"ignoreNullFields": "false"}).alias("json"))


def export_alerts(alerts: DataFrame, path: str) -> None:
    """Write the JSON documents, one per line."""
    alerts_json(alerts).select("json").write.mode("overwrite").text(path)


def recommended_actions(alerts: DataFrame) -> DataFrame:
    """One row per recommended action with its label; unknown actions verbatim."""
    one = alerts.select("line_number", "source_ip",
                        F.posexplode("analysis.recommended_actions").alias("position", "action"))
    action = F.col("action")
    return one.withColumn("label", F.when(
        action == "block_ip", F.concat(F.lit("Block "), F.col("source_ip"))
    ).otherwise(lookup(action, config.ACTION_LABELS, action)))


def cve_references(alerts: DataFrame) -> DataFrame:
    """One row per referenced CVE with its link."""
    one = alerts.select("line_number", F.posexplode("analysis.cve_refs").alias("position", "cve"))
    return one.withColumn("link", F.concat(F.lit(config.CVE_LINK_PREFIX), F.col("cve")))
