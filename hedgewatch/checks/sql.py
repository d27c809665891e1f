"""The same inputs as DuckDB SQL: named CTEs and a builder that strings together
the ones a statement needs."""

from __future__ import annotations

import re

from hedgewatch import config
from hedgewatch.checks.templates import AGENTS, ANSWERS, TEMPLATES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def case(column: str, table: dict, default: str) -> str:
    def literal(v) -> str:
        return text(v) if isinstance(v, str) else f"{float(v)!r}::DOUBLE"
    whens = " ".join(f"WHEN {text(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def joined(column: str) -> str:
    return f"array_to_string({column}, ',')"


_FIELDS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) ([^ "]*) HTTP/[0-9.]+" (\d{3}) (\S+)'
_NAMES = "['ip','time','method','uri','status','size','referer','agent']"
_NGINX = text(_FIELDS + r'(?: ("[^"]*"))?(?: ("[^"]*"))?')
_APACHE = text(_FIELDS + r'(?:\s+("[^"]*"))?(?:\s+("[^"]*"))?')
_TIME = text(r"^( ?\d|\d\d)/([A-Za-z]{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})\s+(Z|[+-]\d\d:?\d\d(?::?\d\d)?)$")
_BLANKS = text(r"^\s+|\s+$")


def _lines() -> str:
    agents = listed(AGENTS)
    ip = "'10.' || (user_id % 250) || '.' || (event_id % 200) || '.' || (user_id % 99)"
    values = {"IP": ip, "TS": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
              "SZ": "CAST(floor(value * 100) AS BIGINT)::VARCHAR",
              "AGENT": f"{agents}[user_id % {len(AGENTS)} + 1]",
              "U": "user_id::VARCHAR", "E": "event_id::VARCHAR"}
    line = "line"
    for name, value in values.items():
        line = f"replace({line}, '@{name}@', {value})"
    rows = ", ".join(f"({i}, {text(t)})" for i, t in enumerate(TEMPLATES))
    return (f"SELECT event_id + 1 AS line_number, {line} AS value, event_id, user_id, event_type, ts "
            f"FROM events JOIN (VALUES {rows}) AS templates(t, line) ON t = event_id % {len(TEMPLATES)}")


def _parsed(source: str) -> str:
    """One row per line, NULL columns where a line does not match."""
    nginx_like = f"""(regexp_replace(value, '\\s+$', '') LIKE '%"-"')"""
    of_line = f"CASE WHEN {nginx_like} THEN 'nginx' ELSE 'apache' END"
    expression = {
        "auto": "(SELECT arg_min(" + of_line + ", line_number) FROM lines WHERE line_number <= 10)",
        "per_line": of_line,
    }.get(source, text(source))
    nginx_optional = "CASE WHEN f.{0} NOT IN ('', '\"-\"') THEN replace(f.{0}, '\"', '') END"
    apache_optional = "CASE WHEN f.{0} NOT IN ('', '\"-\"', '\"\"') THEN replace(f.{0}, '\"', '') END"

    def optional(name: str) -> str:
        return (f"CASE WHEN source = 'nginx' THEN {nginx_optional.format(name)} "
                f"ELSE {apache_optional.format(name)} END")

    return f"""
    SELECT *, local - to_seconds(CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * offset_seconds) AS instant,
      CASE WHEN f.size = '-' THEN 0 ELSE try_cast(f.size AS BIGINT) END AS size_value,
      try_cast(f.status AS INTEGER) AS status_value,
      CASE WHEN contains(f.uri, '?') THEN left(f.uri, instr(f.uri, '?') - 1) ELSE f.uri END AS raw_path,
      CASE WHEN contains(f.uri, '?') THEN substr(f.uri, instr(f.uri, '?') + 1) END AS raw_query,
      {optional('agent')} AS agent_value, {optional('referer')} AS referer_value
    FROM (SELECT *, replace(regexp_extract(f.time, {_TIME}, 7), ':', '') AS z,
      CASE WHEN regexp_matches(f.time, {_TIME}) THEN try_strptime(trim(regexp_extract(f.time, {_TIME}, 1)) || regexp_extract(f.time, '/[^ ]*'), '%d/%b/%Y:%H:%M:%S') END AS local,
      CASE WHEN length(z) > 1 THEN substr(z, 2, 2)::INT * 3600 + substr(z, 4, 2)::INT * 60 + coalesce(try_cast(substr(z, 6, 2) AS INT), 0) ELSE 0 END AS offset_seconds
    FROM (
      SELECT *, CASE WHEN source = 'nginx' THEN regexp_matches(raw_line, {_NGINX}) ELSE regexp_matches(raw_line, {_APACHE}) END AS shaped,
        CASE WHEN source = 'nginx' THEN regexp_extract(raw_line, {_NGINX}, {_NAMES})
             ELSE regexp_extract(raw_line, {_APACHE}, {_NAMES}) END AS f
      FROM (SELECT *, regexp_replace(value, {_BLANKS}, '', 'g') AS raw_line, {expression} AS source FROM lines)))"""


VALID = ("shaped AND instant IS NOT NULL AND size_value IS NOT NULL AND status_value BETWEEN 100 AND 599")


def _log(parsed: str) -> str:
    return f"""
    SELECT line_number, epoch(instant)::BIGINT AS epoch,
      strftime(local, '%Y-%m-%dT%H:%M:%S')
        || substr(z, 1, 3) || ':' || substr(z, 4, 2) || CASE WHEN length(z) > 5 THEN ':' || substr(z, 6, 2) ELSE '' END AS ts_iso,
      f.ip AS source_ip, upper(f.method) AS method, url_decode(url_decode(raw_path)) AS path,
      status_value AS status_code, source, agent_value AS user_agent, size_value AS response_size,
      url_decode(url_decode(raw_query)) AS query_string, referer_value AS referer, raw_line,
      event_id, user_id, event_type
    FROM {parsed} WHERE {VALID}"""


def any_text() -> str:
    return "concat_ws(' ', coalesce(path, ''), nullif(query_string, ''), nullif(user_agent, ''))"


def _detected() -> str:
    fields = {"path": "path", "user_agent": "user_agent", "any": "any_text"}
    tests = ", ".join(
        f"CASE WHEN regexp_matches({fields[field]}, {text(('(?i)' if caseless else '') + pattern)}) THEN {i + 1} END"
        for i, (_, _, field, _, caseless, pattern) in enumerate(config.BUILTIN_RULES))
    names = listed(r[0] for r in config.BUILTIN_RULES)
    types = listed(r[3] for r in config.BUILTIN_RULES)
    scores = "[" + ", ".join(f"{r[1]!r}::DOUBLE" for r in config.BUILTIN_RULES) + "]"
    return f"""
    SELECT *, coalesce(attack_types[1], '') AS primary_type, len(matched_rules) > 0 AS matched FROM (
      SELECT * EXCLUDE (hits, all_types),
        list_transform(hits, lambda h: ({names})[h]) AS matched_rules,
        list_filter(all_types, lambda x, i: list_position(all_types, x) = i) AS attack_types,
        coalesce(list_max(list_transform(hits, lambda h: ({scores})[h])), 0.0::DOUBLE) AS rule_score
      FROM (SELECT *, list_transform(hits, lambda h: ({types})[h]) AS all_types FROM (
        SELECT *, list_filter([{tests}], lambda h: h IS NOT NULL) AS hits
        FROM (SELECT *, {any_text()} AS any_text FROM log))))"""


SCORE = "((event_id * 37) % 101) / 100.0::DOUBLE"
MERGED = ("least(greatest((0.7::DOUBLE * ml_score + 0.3::DOUBLE * rule_score) / (0.7::DOUBLE + 0.3::DOUBLE), "
          "ml_score * 0.85::DOUBLE), 1.0::DOUBLE)")


def mask(expression: str, blob: int) -> str:
    hosts = "|".join(re.escape(h) for h in config.INTERNAL_HOSTS)
    steps = ((r"\b[0-9a-f]{16,}\b", "{hash}"), (rf"(?i)\b[a-z0-9+/]{{{blob},}}={{0,2}}\b", "{encoded}"),
             (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "{ip}"), (rf"\b(?:{hosts})\b", "{internal_host}"),
             (r"\b\d+\b", "{num}"))
    for pattern, replacement in steps:
        expression = f"regexp_replace({expression}, {text(pattern)}, {text(replacement)}, 'g')"
    return expression


def masked_token(column: str, blob: int = config.KEY_BLOB_LENGTH) -> str:
    return mask(f"regexp_replace(lower(url_decode(url_decode(coalesce({column}, '')))), {_BLANKS}, '', 'g')", blob)


def canonical(table: str) -> str:
    """``table`` with ``canonical_key``; path segments are mapped one by one."""
    segment = ("CASE WHEN i > 1 AND regexp_full_match(s, '\\d+') THEN '{id}' "
               "WHEN i > 1 AND regexp_full_match(s, '[0-9a-f]{8,}') THEN '{hash}' ELSE s END")
    once = "url_decode(replace({0}, '+', ' '))"
    key = once.format("CASE WHEN contains(p, '=') THEN left(p, instr(p, '=') - 1) ELSE p END")
    value = once.format("CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END")
    pair = "{'k': lower(" + key + "), 'v': " + masked_token(value) + "}"
    scanners = "|".join(config.SCANNER_AGENTS)
    return f"""
    SELECT * EXCLUDE (k_path, k_query, k_agent), upper(method) || ' '
      || CASE WHEN k_path = '/' THEN '/' ELSE {masked_token('k_path')} END || '?'
      || coalesce(array_to_string(list_transform(list_sort(list_transform(
           list_filter(string_split(k_query, '&'), lambda p: p <> ''), lambda p: {pair})),
           lambda x: x.k || '=' || x.v), '&'), '')
      || ' ua=' || CASE WHEN regexp_matches(k_agent, '{scanners}') THEN 'scanner' ELSE '' END AS canonical_key
    FROM (SELECT * EXCLUDE (flat), array_to_string(list_transform(string_split(flat, '/'), lambda s, i: {segment}), '/') AS k_path
      FROM (SELECT *, regexp_replace(coalesce(nullif(lower(url_decode(url_decode(coalesce(path, '')))), ''), '/'), '/+', '/', 'g') AS flat,
              url_decode(url_decode(coalesce(query_string, ''))) AS k_query,
              lower(url_decode(url_decode(coalesce(user_agent, '')))) AS k_agent
            FROM {table}))"""


def type_name(column: str) -> str:
    name = f"trim(lower(coalesce(nullif({column}, ''), 'unknown')))"
    return case(name, config.ATTACK_TYPE_ALIASES, name)


def context_type(types: str = "attack_types") -> str:
    return (f"coalesce(list_filter(list_transform({types}, lambda a: {type_name('a')}), "
            "lambda a: a NOT IN ('', 'unknown', 'normal'))[1], 'unknown')")


def family(attack_type: str, rules: str = "matched_rules") -> str:
    whens = " ".join(f"WHEN contains(lower(r), '{f}') THEN '{f}'" for f in config.RULE_FAMILIES)
    of_rule = f"CASE {whens} WHEN contains(lower(r), 'path_traversal') THEN 'lfi' END"
    return (f"coalesce(list_filter(list_transform({rules}, lambda r: {of_rule}), "
            f"lambda x: x IS NOT NULL)[1], {attack_type})")


def confidence_value(column: str) -> str:
    return (f"CASE WHEN {column} IS NULL THEN 1.0::DOUBLE WHEN {column} = 'null' THEN 0.0::DOUBLE "
            f"ELSE coalesce(try_cast({column} AS DOUBLE), 0.0::DOUBLE) END")


def severity_name(column: str) -> str:
    name = f"lower(trim(coalesce({column}, '')))"
    alias = case(name, config.SEVERITY_ALIASES, name)
    return f"CASE WHEN {alias} IN ('critical','high','medium','low') THEN {alias} END"


def score_severity(column: str) -> str:
    whens = " ".join(f"WHEN {column} >= {floor!r}::DOUBLE THEN '{name}'" for name, floor in config.SEVERITY_FLOORS)
    return f"CASE {whens} ELSE 'low' END"


def threshold(column: str) -> str:
    return case(column, config.SIMILARITY_BY_TYPE, f"{config.DEFAULT_SIMILARITY!r}::DOUBLE")


def compatible(context: str, cached: str) -> str:
    return f"CASE WHEN {context} = 'unknown' THEN {cached} IN ('unknown', 'normal') ELSE {context} = {cached} END"


def decision(cached: str, cached_family: str, confidence: str, similarity: str, context: str,
             context_family: str) -> tuple[str, str]:
    """``(accepted, reason)`` expressions."""
    limit = threshold(f"CASE WHEN {context} <> 'unknown' THEN {context} ELSE {cached} END")
    shown = f"printf('%.2f', {limit})"
    ladder = (
        (f"{cached} IN ('normal', 'unknown', 'csrf')", "FALSE", f"'cached_type_exact_only:' || {cached}"),
        (f"{confidence} < 0.8::DOUBLE", "FALSE", "'cached_confidence_below_0.8'"),
        (f"{similarity} < {limit}", "FALSE", f"'similarity<' || {shown}"),
        (f"{context} = 'unknown'", "FALSE", "'unknown_context_no_semantic_reuse'"),
        (f"{context} = {cached}", "TRUE", f"'same_attack_type:' || {cached} || ' similarity>=' || {shown}"),
        (f"{context_family} <> {cached_family}", "FALSE", f"'attack_type_mismatch:' || {context} || '!=' || {cached}"),
    )
    accepted = " ".join(f"WHEN {c} THEN {a}" for c, a, _ in ladder)
    reason = " ".join(f"WHEN {c} THEN {r}" for c, _, r in ladder)
    last = f"'same_rule_family:' || {cached_family} || ' similarity>=' || {shown}"
    return f"CASE {accepted} ELSE TRUE END", f"CASE {reason} ELSE {last} END"


def verdict_columns(answer: str = "answer") -> str:
    """Columns ``v_*`` of a fence-free answer."""
    ok = f"coalesce(json_valid({answer}) AND json_type(CASE WHEN json_valid({answer}) THEN {answer} END) = 'OBJECT', FALSE)"

    def get(name: str) -> str:
        return f"CASE WHEN is_object THEN json_extract_string(document, '$.{name}') END"

    def strings(name: str) -> str:
        return f"CASE WHEN is_object THEN CAST(json_extract(document, '$.{name}') AS VARCHAR[]) END"

    return f"""
      SELECT * EXCLUDE (is_object, document),
        CASE WHEN is_object THEN {get('attack_type')} ELSE 'unknown' END AS v_attack_type,
        CASE WHEN NOT is_object THEN '0.0' WHEN json_type(document, '$.confidence') = 'NULL' THEN 'null'
             ELSE {get('confidence')} END AS v_confidence,
        CASE WHEN is_object THEN {get('severity')} ELSE 'medium' END AS v_severity,
        CASE WHEN is_object THEN {get('explanation')} ELSE {text(config.FALLBACK_EXPLANATION)} END AS v_explanation,
        CASE WHEN is_object THEN {strings('recommended_actions')} ELSE ['monitor'] END AS v_actions,
        CASE WHEN is_object THEN {strings('cve_refs')} ELSE [] END AS v_cves,
        {get('risk_score')} AS v_risk, try_cast({get('label')} AS INTEGER) AS v_label,
        CASE WHEN is_object THEN line_number % 700 ELSE 0 END AS v_in, CASE WHEN is_object THEN line_number % 90 ELSE 0 END AS v_out
      FROM (SELECT *, {ok} AS is_object, CASE WHEN {ok} THEN {answer}::JSON END AS document FROM answered)"""


def strip_fences(column: str) -> str:
    trimmed = f"regexp_replace({column}, {_BLANKS}, '', 'g')"
    for pattern in ("^```json", "^```", "```$"):
        trimmed = f"regexp_replace({trimmed}, '{pattern}', '')"
    return f"regexp_replace({trimmed}, {_BLANKS}, '', 'g')"


def _answered(table: str) -> str:
    return (f"SELECT *, {strip_fences('raw')} AS answer FROM (SELECT *, "
            f"({listed(ANSWERS)})[line_number % {len(ANSWERS)} + 1] AS raw FROM {table})")


LATENCY = "(event_id * 7919 % 10007) / 100.0::DOUBLE"


def _alerts() -> str:
    return f"""
    SELECT 's' || user_id AS session_id, {LATENCY} AS latency_ms, line_number, ts_iso AS "timestamp", source_ip,
      method, path, query_string, status_code, user_agent, raw_line, merged_score, rule_score, ml_score,
      coalesce({severity_name('v_severity')}, {score_severity('merged_score')}) AS severity,
      event_type IN ('view', 'click') AS cache_hit,
      CASE event_type WHEN 'view' THEN 'exact' WHEN 'click' THEN 'semantic' END AS cache_hit_type,
      CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 0.912345::DOUBLE END AS cache_similarity,
      CASE WHEN event_type IN ('view', 'click') THEN primary_type END AS cached_attack_type,
      matched_rules, attack_types,
      CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE v_in END AS input_tokens,
      CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE v_out END AS output_tokens,
      v_attack_type, v_confidence, v_severity, v_explanation, v_actions, v_cves
    FROM judged"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), _lines()),
    **{f"parsed_{s}": (("lines",), _parsed(s)) for s in ("auto", "per_line", "nginx", "apache")},
    **{f"log_{s}": ((f"parsed_{s}",), _log(f"parsed_{s}")) for s in ("auto", "per_line", "nginx", "apache")},
    "log": (("parsed_auto",), _log("parsed_auto")),
    "detected": (("log",), _detected()),
    "scored": (("detected",), f"SELECT *, {MERGED} AS merged_score FROM (SELECT *, {SCORE} AS ml_score FROM detected)"),
    "flagged": (("scored",), "SELECT * FROM scored WHERE merged_score >= 0.5::DOUBLE"),
    "keyed": (("flagged",), canonical("flagged")),
    "contexts": (("keyed",), f"SELECT *, {family('context_type')} AS context_family "
                             f"FROM (SELECT *, {context_type()} AS context_type FROM keyed)"),
    "answered": (("flagged",), _answered("flagged")),
    "judged": (("answered",), verdict_columns()),
    "alerts": (("judged",), _alerts()),
    "sessions": ((), """SELECT 's' || s_suppkey AS session_id,
        CASE WHEN s_acctbal < 0 THEN 'idle' WHEN s_nationkey < 5 THEN 'processing' ELSE 'done' END AS status,
        s_suppkey AS progress, s_suppkey * 2 AS total_lines, s_acctbal + s_suppkey / 1000.0::DOUBLE AS created_at
      FROM supplier"""),
}


def statement(final: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``final`` behind the CTEs it needs; ``extra`` are further CTEs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dependency in CTES[name][0]:
                visit(dependency)
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order]
    parts += [f"{name} AS MATERIALIZED ({body})" for name, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
