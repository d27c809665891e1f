"""Ingest, rules and scores: registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.checks import inputs
from hedgewatch.checks.registry import comma, register
from hedgewatch.checks.sql import MERGED, SCORE, VALID, any_text, joined, score_severity, statement, text
from hedgewatch.functions.severity import score_severity as score_severity_column
from hedgewatch.operators import detect, ingest, score
from hedgewatch.session import checkpoint_dir
from hedgewatch.sources import indicators, logs, rules

LOG = ("line_number", "epoch", "ts_iso", "source_ip", "method", "path", "status_code", "source",
       "user_agent", "response_size", "query_string", "referer", "raw_line")


def _log_columns(log: DataFrame) -> DataFrame:
    return log.withColumn("epoch", F.unix_timestamp("timestamp")).select(*LOG)


def _log_query(source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _log_columns(inputs.access_log(spark, sf_dir, source))
    return run


for _source in ("auto", "per_line", "nginx", "apache"):
    register(f"access_log_{_source}", statement(
        f"SELECT {', '.join(LOG)} FROM log_{_source}", f"log_{_source}"))(_log_query(_source))


@register("log_directory_scan", statement(
    "SELECT line_number, md5(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS line FROM lines", "lines"))
def log_directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as a directory of text files and read back with global numbers."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4()}"
    lines = inputs.raw_lines(spark, sf_dir)
    lines.repartitionByRange("line_number").sortWithinPartitions("line_number").select(
        "value").write.text(path)
    # the folder's own _SUCCESS marker is not a log
    read = logs.read_logs(spark, path, underscore="skip")
    return read.select("line_number", F.md5(F.trim("value")).alias("line"))


@register("log_file_rows", statement(
    "SELECT line_number, method, path FROM log_auto", "log_auto"))
def log_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single-file load through the ingest job."""
    path = f"{checkpoint_dir(spark)}/file-{uuid.uuid4()}"
    inputs.raw_lines(spark, sf_dir).orderBy("line_number").coalesce(1).select("value").write.text(path)
    file = [full for name, full in logs.log_files(spark, path) if name.startswith("part-")][0]
    return logs.parse_file(spark, file).select("line_number", "method", "path")


@register("source_detection", statement("SELECT source FROM parsed_auto LIMIT 1", "parsed_auto"))
def source_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_source(inputs.raw_lines(spark, sf_dir))


@register("rejected_lines", statement(
    f"SELECT line_number, raw_line AS raw FROM parsed_auto WHERE NOT ({VALID}) OR ({VALID}) IS NULL",
    "parsed_auto"))
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejects(inputs.raw_lines(spark, sf_dir))


@register("parse_rate", statement(
    f"""SELECT count(*) FILTER (WHERE raw_line NOT LIKE '#%') AS candidates,
      count(*) FILTER (WHERE raw_line NOT LIKE '#%' AND {VALID}) AS parsed,
      count(*) FILTER (WHERE raw_line NOT LIKE '#%' AND {VALID})::DOUBLE
        / count(*) FILTER (WHERE raw_line NOT LIKE '#%') AS rate FROM parsed_auto""", "parsed_auto"))
def parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_rate(inputs.raw_lines(spark, sf_dir))


@register("normalized_events", statement(
    """SELECT page_id, 'GET' AS method, url_decode(url_decode(url)) AS path,
         url_decode(url_decode(replace(html, '%', '%25'))) = replace(html, '%', '%25') AS same FROM pages"""
).replace("url_decode(url_decode(replace(html, '%', '%25'))) = replace(html, '%', '%25')",
          "md5(url_decode(url_decode(replace(replace(html, '%', ' '), '<', '%253C')))) ").replace(" AS same", " AS content"))
def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured events with content, brought to log form: pages as requests."""
    events = inputs.table(spark, sf_dir, "pages").select(
        "page_id", F.lit("get").alias("method"), F.col("url").alias("path"),
        F.lit(200).alias("status_code"),
        F.replace(F.replace("html", F.lit("%"), F.lit(" ")), F.lit("<"), F.lit("%253C")).alias("content"))
    return ingest.normalize(events).select("page_id", "method", "path", F.md5("content").alias("content"))


@register("rule_input_text", statement(
    f"SELECT line_number, {any_text()} AS any_text FROM log", "log"))
def rule_input_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.access_log(spark, sf_dir)
    return log.select("line_number", detect.any_text(log.columns).alias("any_text"))


@register("rule_detection", statement(
    f"SELECT line_number, {joined('matched_rules')} AS matched_rules, {joined('attack_types')} AS attack_types, "
    "rule_score, primary_type, matched FROM detected", "detected"))
def rule_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.detected(spark, sf_dir).select(
        "line_number", comma("matched_rules"), comma("attack_types"), "rule_score", "primary_type", "matched")


@register("rule_hit_counts", statement(
    "SELECT rule, count(*) AS events, min(line_number) AS first_line FROM "
    "(SELECT line_number, unnest(matched_rules) AS rule FROM detected) GROUP BY rule", "detected"))
def rule_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.rule_hits(inputs.detected(spark, sf_dir)).groupBy("rule").agg(
        F.count("*").alias("events"), F.min("line_number").alias("first_line"))


# Rule sources are small by nature; here one directive or rule per part, so that
# the work grows with the table.
_ID = ("CASE WHEN p_size < 10 THEN 930000 WHEN p_size < 20 THEN 932000 WHEN p_size < 30 THEN 941000 "
       "WHEN p_size < 40 THEN 942000 ELSE 920000 END + p_partkey % 1000")
_TARGET = ("CASE p_type WHEN 'ECONOMY' THEN 'ARGS|REQUEST_COOKIES' WHEN 'STANDARD' THEN 'REQUEST_HEADERS:User-Agent' "
           "WHEN 'PROMO' THEN '!REQUEST_FILENAME' ELSE 'REQUEST_HEADERS:Referer' END")
_REGEX = "CASE WHEN p_size = 11 THEN '.*' WHEN p_size = 12 THEN '.+' ELSE replace(p_name, ' ', '\\s+') END"
_KIND = ("CASE WHEN {0} BETWEEN 941000 AND 941999 THEN 'xss' WHEN {0} BETWEEN 942000 AND 942999 THEN 'sqli' "
         "WHEN {0} BETWEEN 930000 AND 930999 THEN 'lfi' WHEN {0} BETWEEN 932000 AND 932999 THEN 'rce' END")


@register("rule_conf_scan", f"""
    SELECT p_partkey AS part, id, regex, target, {_KIND.format('id')} AS attack_type
    FROM (SELECT p_partkey, {_ID} AS id, replace({_REGEX}, '\\s+', '\\s*') AS regex, {_TARGET} AS target FROM part)
    WHERE {_KIND.format('id')} IS NOT NULL""")
def rule_conf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    regex = _REGEX.replace("\\", "\\\\")
    part = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file"), F.expr(_ID).cast("string").alias("id"),
        F.replace(F.expr(regex), F.lit("\\s+"), F.lit("\\s*")).alias("regex"), F.expr(_TARGET).alias("target"))
    conf = F.concat(
        F.lit("# comment\nSecAction \"id:900000,phase:1\"\nSecRule "), F.col("target"), F.lit(" \"@rx "), F.col("regex"),
        F.lit("\" \\\n    \"id:"), F.col("id"), F.lit(",phase:2,\\\n    block\"\n"),
        F.lit("SecRule ARGS \"@rx without\" \"phase:2,block\"\n"))
    found = rules.parse_rule_conf(part.select("file", conf.alias("text")))
    return found.select(F.col("file").alias("part"), "id", "regex", "target", "attack_type")


@register("imported_rule_hygiene", f"""
    SELECT id, 'crs_' || id AS name, 0.75::DOUBLE AS score, '(?iUd)' || regex AS pattern,
      CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'any' ELSE 'user_agent' END AS field,
      {_KIND.format('id')} AS attack_type, 'crs' AS source
    FROM (SELECT p_type, {_ID} AS id, {_REGEX} AS regex FROM part)
    WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND regex NOT IN ('.*', '.+') AND id <> 942130""")
def imported_rule_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.table(spark, sf_dir, "part").select(
        F.expr(_ID).alias("id"), F.expr(_REGEX.replace("\\", "\\\\")).alias("regex"),
        F.expr(_TARGET).alias("target"))
    return rules.imported_rules(raw.withColumn("attack_type", F.expr(_KIND.format("id"))))


_IMPORTED = f"""SELECT id, regex, attack_type, target, p_size FROM (
    SELECT p_size, {_KIND.format('id')} AS attack_type, id, regex, target
    FROM (SELECT p_size, {_ID} AS id, {_REGEX} AS regex, {_TARGET} AS target FROM part))"""


def _rule_files(spark: SparkSession, sf_dir: str) -> str:
    """Rule JSON as configuration has it: a file holds one array, here of the rules of one part size."""
    path = f"{checkpoint_dir(spark)}/rules-{uuid.uuid4()}"
    rows = inputs.table(spark, sf_dir, "part").select(
        "p_size", F.expr(_ID).cast("int").alias("id"), F.expr(_REGEX.replace("\\", "\\\\")).alias("regex"), F.expr(_TARGET).alias("target"))
    rows = rows.withColumn("attack_type", F.expr(_KIND.format("id")))
    arrays = rows.groupBy("p_size").agg(F.to_json(F.collect_list(F.struct("id", "regex", "attack_type", "target"))).alias("value"))
    arrays.write.partitionBy("p_size").text(path)
    return path


@register("rule_json_scan", f"SELECT id, regex, attack_type, target, count(*) AS rules FROM ({_IMPORTED}) GROUP BY ALL")
def rule_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.read_rule_json(spark, _rule_files(spark, sf_dir)).groupBy("id", "regex", "attack_type", "target").agg(
        F.count("*").alias("rules"))


@register("rule_union", f"""
    SELECT name, score, field, attack_type, source, count(*) AS rules, count(DISTINCT pattern) AS patterns FROM (
      SELECT 'crs_' || id AS name, 0.75::DOUBLE AS score, CASE WHEN target LIKE '%User-Agent' THEN 'user_agent' ELSE 'any' END AS field,
        attack_type, 'crs' AS source, regex AS pattern FROM ({_IMPORTED})
      WHERE target NOT LIKE '%Referer' AND regex NOT IN ('.*', '.+') AND id <> 942130
      UNION ALL SELECT * FROM (VALUES {', '.join(f"({text(r[0])}, {r[1]!r}::DOUBLE, {text(r[2])}, {text(r[3])}, 'custom', {text(r[5])})" for r in config.BUILTIN_RULES)}))
    GROUP BY ALL""")
def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in and imported rules in one table, as the rule scan takes them."""
    return rules.load_rules(spark, _rule_files(spark, sf_dir)).groupBy("name", "score", "field", "attack_type", "source").agg(
        F.count("*").alias("rules"), F.countDistinct("pattern").alias("patterns"))


# a rule for every pair of part type and size, hundreds whatever the table's size
_NUMBERED = """(SELECT row_number() OVER (ORDER BY p_type, p_size) - 1 AS n FROM (SELECT DISTINCT p_type, p_size FROM part))"""


@register("imported_rule_hits", statement(
    f"""SELECT rule, count(*) AS events, min(line_number) AS first_line FROM (
      SELECT unnest(matched_rules) AS rule, line_number FROM detected
      UNION ALL SELECT 'crs_' || (941000 + n), line_number
      FROM (SELECT *, {any_text()} AS any_text FROM log) l, {_NUMBERED} r
      WHERE regexp_matches(any_text, '(?i)(?:shelf|USER|page)=' || n || '(?:[^0-9]|$)')) GROUP BY rule""", "detected", "log"))
def imported_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of imported rules on all lines; most lines hold no text that one of them needs."""
    kinds = inputs.table(spark, sf_dir, "part").select("p_type", "p_size").distinct()
    raw = kinds.select((F.row_number().over(Window.orderBy("p_type", "p_size")) + 940999).cast("bigint").alias("id")).select(
        "id", F.concat(F.lit("(?:shelf|USER|page)="), F.col("id") - 941000, F.lit("(?:[^0-9]|$)")).alias("regex"),
        F.lit("xss").alias("attack_type"), F.lit("ARGS").alias("target"))
    table = rules.with_imported(spark, raw)
    found = detect.apply_rules(inputs.access_log(spark, sf_dir), table)
    return detect.rule_hits(found).groupBy("rule").agg(F.count("*").alias("events"), F.min("line_number").alias("first_line"))


@register("indicator_paths", """
    SELECT DISTINCT path FROM (
      SELECT unnest(['/product/' || (c_custkey % 1000), '/nation/' || c_nationkey]) AS path FROM customer
      UNION ALL SELECT '/old/' || c_mktsegment FROM customer)""")
def indicator_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.flatten_indicators(_indicator_documents(spark, sf_dir))


def _indicator_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    new = F.array(F.concat(F.lit("/product/"), (F.col("c_custkey") % 1000).cast("string")),
                  F.concat(F.lit("/nation/"), F.col("c_nationkey").cast("string")))
    old = F.array(F.concat(F.lit("/old/"), F.col("c_mktsegment")))
    return inputs.table(spark, sf_dir, "customer").select(F.to_json(F.create_map(
        F.concat(F.lit("CVE-A-"), key), F.struct(new.alias("indicator_paths"), F.lit(None).cast("array<string>").alias("paths")),
        F.concat(F.lit("CVE-B-"), key), F.struct(F.lit(None).cast("array<string>").alias("indicator_paths"), old.alias("paths")),
    )).alias("value"))


@register("indicator_matches", statement("""
    SELECT line_number, path FROM log WHERE path IN (
      SELECT '/product/' || (c_custkey % 1000) FROM customer)""", "log"))
def indicator_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = indicators.flatten_indicators(_indicator_documents(spark, sf_dir))
    return indicators.match_cve(inputs.access_log(spark, sf_dir), paths).select("line_number", "path")


@register("serving_text", statement(
    "SELECT line_number, concat_ws(' ', coalesce(path, ''), nullif(query_string, ''), nullif(user_agent, '')) "
    "AS text FROM log", "log"))
def serving_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.access_log(spark, sf_dir)
    return log.select("line_number", score.serving_text(log.columns).alias("text"))


@register("merged_scores", statement(
    f"SELECT line_number, round(ml_score, 6) AS ml_score, round(merged_score, 6) AS merged_score, "
    f"{score_severity('merged_score')} AS severity FROM scored", "scored"))
def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score.merge_scores(inputs.with_given_score(inputs.detected(spark, sf_dir)))
    return scored.select("line_number", F.round("ml_score", 6).alias("ml_score"),
                         F.round("merged_score", 6).alias("merged_score"),
                         score_severity_column(F.col("merged_score")).alias("severity"))


@register("flagged_events", statement(
    f"SELECT line_number, {joined('attack_types')} AS attack_types, round(merged_score, 6) AS merged_score FROM flagged",
    "flagged"))
def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.flagged(spark, sf_dir).select(
        "line_number", comma("attack_types"), F.round("merged_score", 6).alias("merged_score"))


@register("flagged_by_severity", statement(
    f"""SELECT severity, count(*) AS events, count(DISTINCT source_ip) AS sources, round(avg(merged_score), 6) AS mean_score
    FROM (SELECT *, {score_severity('merged_score')} AS severity FROM flagged) GROUP BY severity""", "flagged"))
def flagged_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: log lines to severity counts of flagged events."""
    flagged = inputs.flagged(spark, sf_dir)
    return flagged.groupBy(score_severity_column(F.col("merged_score")).alias("severity")).agg(
        F.count("*").alias("events"), F.countDistinct("source_ip").alias("sources"),
        F.round(F.avg("merged_score"), 6).alias("mean_score"))
