"""Verdicts and alerts: registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.checks import inputs
from hedgewatch.checks.registry import comma, register
from hedgewatch.checks.sql import (
    case, joined, score_severity, severity_name, statement, text,
)
from hedgewatch.functions.verdict import confidence_value
from hedgewatch.operators import alerts as alert_ops
from hedgewatch.operators import verdicts
from hedgewatch.session import checkpoint_dir, cut_lineage


def _flat(column: str) -> str:
    decoded = f"url_decode(url_decode(coalesce({column}, '')))"
    return f"regexp_replace({decoded}, '[\\n\\r]', ' ', 'g')"


_SUMMARY = f"""concat_ws(chr(10), 'method=' || method, 'path=' || {_flat('path')}, 'status=' || status_code,
  'merged_score=' || printf('%.3f', merged_score), 'rule_score=' || printf('%.3f', rule_score),
  'ml_score=' || printf('%.3f', ml_score), 'query=' || nullif({_flat('query_string')}, ''),
  'user_agent=' || nullif({_flat('user_agent')}, ''), 'rule_attack_types=' || nullif({joined('attack_types')}, ''),
  'matched_rules=' || nullif({joined('matched_rules')}, ''))"""
_CONTEXT = f"""concat_ws(chr(10), 'pipeline_scope=single_request_content_only', 'behavior_detection=disabled', 'source=' || source,
  'rule_attack_types=' || coalesce(nullif({joined('attack_types')}, ''), 'none'), 'matched_rule_count=' || len(matched_rules))"""
_RULE_LIST = ("CASE WHEN len(matched_rules) > 0 THEN chr(10) || chr(10) || 'Matched Local Rules:' || chr(10) || '[''' "
              "|| array_to_string(matched_rules, ''', ''') || ''']' ELSE '' END")
_REQUEST = f"'Event:' || chr(10) || ({_SUMMARY}) || chr(10) || chr(10) || 'Context:' || chr(10) || ({_CONTEXT}) || {_RULE_LIST}"


@register("verdict_requests", statement(
    f"SELECT line_number, {_SUMMARY} AS event_summary, {_CONTEXT} AS context_summary, md5({_REQUEST}) AS request FROM flagged",
    "flagged"))
def verdict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.with_request(inputs.flagged(spark, sf_dir)).select(
        "line_number", "event_summary", "context_summary", F.md5("request").alias("request"))


def _fails(request: str) -> bool:
    return len(request) % 7 == 3


def _echo_provider():
    """Offline provider for the check: the verdict is read off the request; some requests it cannot take."""
    def complete(requests: list[str]) -> list:
        if any(_fails(r) for r in requests):
            raise RuntimeError("cannot take this request")
        return [{"text": '{"attack_type":"%s","confidence":0.9}' % ("sqli" if "sqli" in r else "unknown"),
                 "input_tokens": len(r), "output_tokens": 7} for r in requests]
    return complete


@register("verdict_inference", statement(
    f"""SELECT line_number, length({_REQUEST}) % 7 = 3 AS failed,
      CASE WHEN length({_REQUEST}) % 7 <> 3 AND contains({_REQUEST}, 'sqli') THEN 'sqli' ELSE 'unknown' END AS attack_type,
      CASE WHEN length({_REQUEST}) % 7 <> 3 THEN length({_REQUEST}) ELSE 0 END AS input_tokens,
      CASE WHEN length({_REQUEST}) % 7 <> 3 THEN 7 ELSE 0 END AS output_tokens FROM flagged""", "flagged"))
def verdict_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = verdicts.with_request(inputs.flagged(spark, sf_dir)).select("line_number", "request")
    answers = cut_lineage(verdicts.infer_verdicts(requests, _echo_provider))
    failed = F.col("error").isNotNull().alias("failed")
    return verdicts.parse_verdict(answers.withColumn("told", F.col("error"))).withColumnRenamed("told", "error").select(
        "line_number", failed, "verdict.attack_type", "verdict.input_tokens", "verdict.output_tokens")


def _refusing_provider():
    """Takes what the other one refuses, and nothing else: only what no earlier run has answered may be asked."""
    def complete(requests: list[str]) -> list:
        if not all(_fails(r) for r in requests):
            raise RuntimeError("asked again")
        return ['{"attack_type":"xss"}' for _ in requests]
    return complete


@register("journaled_inference", statement(
    f"""SELECT line_number, length({_REQUEST}) % 7 = 3 AS late,
      CASE WHEN length({_REQUEST}) % 7 = 3 THEN 'xss' WHEN contains({_REQUEST}, 'sqli') THEN 'sqli' ELSE 'unknown' END AS attack_type,
      FALSE AS failed FROM flagged""", "flagged"))
def journaled_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one journal of answers: the second asks for what the first could not get."""
    # written once: both runs read them
    requests = cut_lineage(verdicts.with_request(inputs.flagged(spark, sf_dir)).select("line_number", "request"))
    journal = f"{checkpoint_dir(spark)}/answers-{uuid.uuid4()}"
    verdicts.infer_verdicts(requests, _echo_provider, 256, journal).write.format("noop").mode("overwrite").save()
    answers = cut_lineage(verdicts.infer_verdicts(requests, _refusing_provider, 256, journal))
    failed, late = F.col("error").isNotNull(), F.length("request") % 7 == 3
    return verdicts.parse_verdict(answers.withColumns({"failed": failed, "late": late})).select(
        "line_number", "late", "verdict.attack_type", "failed")


@register("verdict_parsing", statement(
    f"""SELECT line_number, v_label AS label, v_attack_type AS attack_type, v_confidence AS confidence, v_severity AS severity,
      v_explanation AS explanation, {joined('v_actions')} AS recommended_actions, {joined('v_cves')} AS cve_refs,
      v_risk AS risk_score, v_in AS input_tokens, v_out AS output_tokens FROM judged""", "judged"))
def verdict_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.answers(inputs.flagged(spark, sf_dir)).select(
        "line_number", "raw", (F.col("line_number") % 700).alias("input_tokens"), (F.col("line_number") % 90).alias("output_tokens"))
    v = verdicts.parse_verdict(raw)
    return v.select("line_number", *[F.col(f"verdict.{c}") for c in (
        "label", "attack_type", "confidence", "severity", "explanation", "risk_score", "input_tokens", "output_tokens")],
        comma("verdict.recommended_actions"), comma("verdict.cve_refs"))


@register("verdict_fallbacks", statement(
    f"""SELECT v_attack_type AS attack_type, v_explanation AS explanation, count(*) AS events,
      count(*) FILTER (WHERE v_in = 0 AND v_out = 0) AS free FROM judged
    WHERE v_explanation = {text(config.FALLBACK_EXPLANATION)} GROUP BY ALL""", "judged"))
def verdict_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = inputs.with_verdicts(inputs.flagged(spark, sf_dir)).select("verdict.*")
    failed = judged.filter(F.col("explanation") == config.FALLBACK_EXPLANATION)
    return failed.groupBy("attack_type", "explanation").agg(
        F.count("*").alias("events"),
        F.count_if((F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)).alias("free"))


ALERT = ("line_number", "timestamp", "source_ip", "method", "path", "query_string", "status_code", "user_agent",
         "severity", "cache_hit", "cache_hit_type", "cached_attack_type", "input_tokens", "output_tokens")
_ALERT_SQL = ", ".join('"timestamp"' if c == "timestamp" else c for c in ALERT)


@register("alerts", statement(
    f"SELECT {_ALERT_SQL}, {joined('matched_rules')} AS matched_rules, {joined('attack_types')} AS attack_types, "
    "round(merged_score, 6) AS merged_score FROM alerts", "alerts"))
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.alerts(spark, sf_dir).select(
        *ALERT, comma("matched_rules"), comma("attack_types"), F.round("merged_score", 6).alias("merged_score"))


@register("alert_documents", statement(
    """SELECT line_number, path, severity, round(merged_score, 4) AS merged_score, round(cache_similarity, 4) AS cache_similarity,
      v_attack_type AS attack_type, matched_rules[1] AS first_rule, query_string IS NULL AS no_query FROM alerts""", "alerts"))
def alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON documents, read back field by field."""
    doc = F.try_parse_json("json")

    def get(path: str, kind: str = "string"):
        return F.try_variant_get(doc, f"$.{path}", kind)

    return alert_ops.alerts_json(inputs.alerts(spark, sf_dir)).select(
        "line_number", get("path").alias("path"), get("severity").alias("severity"),
        get("merged_score", "double").alias("merged_score"), get("cache_similarity", "double").alias("cache_similarity"),
        get("analysis.attack_type").alias("attack_type"), get("matched_rules[0]").alias("first_rule"),
        F.is_variant_null(F.try_variant_get(doc, "$.query_string", "variant")).alias("no_query"))


@register("severity_names", statement(
    f"""SELECT line_number, {severity_name('v_severity')} AS severity,
      coalesce({severity_name('severity')}, {severity_name('v_severity')}, {score_severity('merged_score')}) AS read_severity FROM alerts""",
    "alerts"))
def severity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hedgewatch.functions.severity import alert_severity, severity_name as name
    return inputs.alerts(spark, sf_dir).select(
        "line_number", name(F.col("analysis.severity")).alias("severity"),
        alert_severity(F.col("severity"), F.col("analysis.severity"), F.col("merged_score")).alias("read_severity"))


_ACTION = case("action", config.ACTION_LABELS, "action")


@register("recommended_actions", statement(
    f"""SELECT line_number, i - 1 AS position, action, CASE WHEN action = 'block_ip' THEN 'Block ' || source_ip ELSE {_ACTION} END AS label
    FROM (SELECT line_number, source_ip, unnest(v_actions) AS action, unnest(range(1, len(v_actions) + 1)) AS i FROM alerts)""", "alerts"))
def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.recommended_actions(inputs.alerts(spark, sf_dir)).drop("source_ip")


@register("cve_references", statement(
    f"""SELECT line_number, i - 1 AS position, cve, '{config.CVE_LINK_PREFIX}' || cve AS link
    FROM (SELECT line_number, unnest(v_cves) AS cve, unnest(range(1, len(v_cves) + 1)) AS i FROM alerts)""", "alerts"))
def cve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.cve_references(inputs.alerts(spark, sf_dir))


@register("verdict_confidence", statement(
    """SELECT v_confidence AS text, count(*) AS events, min(CASE WHEN v_confidence IS NULL THEN 1.0::DOUBLE WHEN v_confidence = 'null' THEN 0.0::DOUBLE
      ELSE coalesce(try_cast(v_confidence AS DOUBLE), 0.0::DOUBLE) END) AS confidence FROM judged GROUP BY v_confidence""", "judged"))
def verdict_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = inputs.with_verdicts(inputs.flagged(spark, sf_dir)).select(F.col("verdict.confidence").alias("text"))
    return judged.groupBy("text").agg(F.count("*").alias("events"), F.min(confidence_value(F.col("text"))).alias("confidence"))
