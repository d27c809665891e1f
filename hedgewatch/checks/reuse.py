"""Canonical keys, reuse policy and reuse joins: registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.checks import inputs
from hedgewatch.checks.registry import register
from hedgewatch.checks.sql import (
    canonical, case, compatible, confidence_value, context_type, decision, family, masked_token,
    statement, threshold, type_name,
)
from hedgewatch.functions import canonical as keys
from hedgewatch.functions import policy
from hedgewatch.functions.verdict import VERDICT, confidence_value as confidence_column
from hedgewatch.operators import reuse
from hedgewatch.session import checkpoint_dir, cut_lineage
from hedgewatch.sources import verdict_store

_PAGE = """SELECT page_id, 'get' AS method, split_part(tail, '?', 1) AS path,
    CASE WHEN contains(tail, '?') THEN substr(tail, instr(tail, '?') + 1) END AS query_string, NULL AS user_agent
  FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS tail FROM pages)"""


def _page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.regexp_replace("url", "^https?://[^/]+", "")
    at = F.instr(F.col("tail"), "?")
    return inputs.table(spark, sf_dir, "pages").select("page_id", tail.alias("tail")).select(
        "page_id", F.lit("get").alias("method"), F.substring_index("tail", "?", 1).alias("path"),
        F.when(at > 0, F.substring(F.col("tail"), at + 1, F.length("tail"))).alias("query_string"),
        F.lit(None).cast("string").alias("user_agent"))


@register("canonical_key_pages", statement(
    "SELECT page_id, canonical_key FROM page_keys", extra={"page_requests": _PAGE, "page_keys": canonical("page_requests")}))
def canonical_key_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.with_canonical_key(_page_requests(spark, sf_dir)).select("page_id", "canonical_key")


@register("canonical_key_log", statement(
    "SELECT line_number, canonical_key FROM log_keys", "log", extra={"log_keys": canonical("log")}))
def canonical_key_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.with_canonical_key(inputs.access_log(spark, sf_dir)).select("line_number", "canonical_key")


@register("masked_query", statement(
    f"SELECT line_number, {masked_token('query_string')} AS masked FROM log", "log"))
def masked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.with_masked_token(inputs.access_log(spark, sf_dir), "query_string", "masked").select(
        "line_number", "masked")


_FAMILY = "CASE " + " ".join(
    f"WHEN regexp_matches(token, {chr(39)}{p.replace(chr(39), chr(39) * 2)}{chr(39)}) THEN '{{{n}}}'"
    for n, p in config.PAYLOAD_FAMILIES) + " ELSE token END"


@register("payload_families", statement(
    f"SELECT payload_family, count(*) AS events FROM (SELECT {_FAMILY} AS payload_family FROM "
    f"(SELECT {masked_token('query_string', config.FAMILY_BLOB_LENGTH)} AS token FROM log)) GROUP BY payload_family", "log"))
def payload_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = keys.with_payload_family(inputs.access_log(spark, sf_dir), "query_string")
    return labelled.groupBy("payload_family").agg(F.count("*").alias("events"))


_NAMES = ["path_traversal", " Path Traversal ", "SQL injection", "none", "", None, "benign", "xss", "file upload",
          "cross_site_scripting", "CSRF"]


def _named(column: str) -> str:
    return "([" + ", ".join("NULL" if n is None else f"'{n}'" for n in _NAMES) + f"])[{column} % {len(_NAMES)} + 1]"


@register("attack_type_names", f"""
    SELECT l_orderkey, l_linenumber, attack_type, {threshold('attack_type')} AS threshold,
      {family('attack_type', "CASE WHEN l_suppkey % 3 = 0 THEN ['dir_scan_x', 'xss_a'] WHEN l_suppkey % 3 = 1 THEN ['crs_1', 'PATH_TRAVERSAL_b'] ELSE [] END")} AS rule_family
    FROM (SELECT *, {type_name(_named('l_partkey'))} AS attack_type FROM lineitem)""")
def attack_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias, threshold and family policy over many rows with odd spellings."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    supplier = F.col("l_suppkey") % 3
    rules = F.when(supplier == 0, F.array(F.lit("dir_scan_x"), F.lit("xss_a"))).when(
        supplier == 1, F.array(F.lit("crs_1"), F.lit("PATH_TRAVERSAL_b"))).otherwise(F.array().cast("array<string>"))
    name = policy.attack_type_name(F.get(names, (F.col("l_partkey") % len(_NAMES)).cast("int")))
    return inputs.table(spark, sf_dir, "lineitem").withColumn("attack_type", name).select(
        "l_orderkey", "l_linenumber", "attack_type", policy.type_threshold(F.col("attack_type")).alias("threshold"),
        policy.rule_family(F.col("attack_type"), rules).alias("rule_family"))


@register("request_contexts", statement(
    "SELECT line_number, canonical_key, context_type, context_family FROM contexts", "contexts"))
def request_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.contexts(spark, sf_dir).select("line_number", "canonical_key", "context_type", "context_family")


_RISK = (f"coalesce(try_cast(v_risk AS DOUBLE), "
         f"{case('lower(v_severity)', config.SEVERITY_RISK, '5.0::DOUBLE')})")


@register("verdict_policy", statement(
    f"""SELECT line_number, cached_type, confidence, {family('cached_type')} AS rule_family, risk_score FROM (
      SELECT *, {type_name('v_attack_type')} AS cached_type, {confidence_value('v_confidence')} AS confidence,
        {_RISK} AS risk_score FROM judged)""", "judged"))
def verdict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = inputs.with_verdicts(inputs.flagged(spark, sf_dir))
    return reuse.with_verdict_policy(judged).select(
        "line_number", "cached_type", "confidence", "rule_family", "risk_score")


# --- nearest entries: the labels 0..4 are the store, 5..9 the requests -----------

_TYPES = ("sqli", "xss", "normal", "lfi", "ssrf", "cve", "sqli", "unknown", "path_traversal", "dir_scan")
_ENTRIES = f"""SELECT * FROM (
    SELECT vec_id AS seq, embedding::DOUBLE[] AS embedding, (ARRAY{list(_TYPES)})[label + 1] AS attack_type,
      (ARRAY{list(_TYPES)})[label + 1] AS rule_family, (vec_id * 7 % 100) / 100.0::DOUBLE AS confidence
    FROM embeddings WHERE label < 5)""".replace("ARRAY", "")


def _with_type(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.get(F.array(*[F.lit(t) for t in _TYPES]), F.col("label")))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _with_type(inputs.table(spark, sf_dir, "embeddings").filter(F.col("label") < 5), "attack_type")
    return stored.select(
        F.col("vec_id").cast("string").alias("canonical_key"), "embedding",
        F.lit(None).cast(VERDICT).alias("verdict"), "attack_type", F.col("attack_type").alias("rule_family"),
        ((F.col("vec_id") * 7 % 100) / 100.0).alias("confidence"), F.col("vec_id").alias("seq"),
    )


def _vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "embeddings").filter(F.col("label") >= 5)
    return _with_type(rows, "context_type").withColumn("context_type", policy.context_type(F.array("context_type"))).select(
        "vec_id", "embedding", "context_type",
        F.when(F.col("vec_id") % 2 == 0, F.lit("xss")).otherwise(F.col("context_type")).alias("context_family"))


_VECTOR_REQUESTS = f"""SELECT vec_id, embedding, context_type,
    CASE WHEN vec_id % 2 = 0 THEN 'xss' ELSE context_type END AS context_family
  FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, {context_type(f"[({list(_TYPES)})[label + 1]]")} AS context_type
        FROM embeddings WHERE label >= 5)"""
_NEAREST = """SELECT r.*, e.best_seq, e.similarity FROM (
    SELECT r.vec_id, arg_max(e.seq, {'s': list_dot_product(r.embedding, e.embedding), 'q': -e.seq}) AS best_seq,
      max(list_dot_product(r.embedding, e.embedding)) AS similarity
    FROM requests r, entries e GROUP BY r.vec_id) e JOIN requests r ON r.vec_id = e.vec_id"""
_NEAR = {"entries": _ENTRIES, "requests": _VECTOR_REQUESTS, "nearest": _NEAREST}


@register("nearest_entry", statement(
    "SELECT vec_id, best_seq, round(similarity, 6) AS similarity FROM nearest", extra=_NEAR))
def nearest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.top1(_vector_requests(spark, sf_dir), _entries(spark, sf_dir)).select(
        "vec_id", "best_seq", F.round("similarity", 6).alias("similarity"))


# Random unit vectors are far apart, so the decision is shown on a similarity
# stretched into the range the thresholds are about.
_ACCEPTED, _REASON = decision("attack_type", "rule_family", "confidence", "stretched", "context_type", "context_family")


@register("similarity_decisions", statement(
    f"SELECT vec_id, {_ACCEPTED} AS accepted, {_REASON} AS reason FROM "
    "(SELECT n.*, least(similarity * 2.5::DOUBLE, 1.0::DOUBLE) AS stretched, attack_type, rule_family, confidence "
    "FROM nearest n JOIN entries e ON e.seq = n.best_seq)", extra=_NEAR))
def similarity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    found = reuse.top1(_vector_requests(spark, sf_dir), entries).join(
        entries.drop("embedding", "verdict"), F.col("best_seq") == F.col("seq"))
    decided = policy.similarity_decision(
        F.col("attack_type"), F.col("rule_family"), F.col("confidence"),
        F.least(F.col("similarity") * 2.5, F.lit(1.0)), F.col("context_type"), F.col("context_family"))
    return found.select("vec_id", decided.alias("d")).select("vec_id", "d.accepted", "d.reason")


@register("similarity_lookup", statement(
    f"""SELECT vec_id, round(similarity, 6) AS similarity, attack_type AS cached_type, {_ACCEPTED.replace('stretched', 'similarity')} AS accepted,
      {_REASON.replace('stretched', 'similarity')} AS reason
    FROM (SELECT n.*, attack_type, rule_family, confidence FROM nearest n JOIN entries e ON e.seq = n.best_seq)""", extra=_NEAR))
def similarity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reuse.similarity_lookup(_vector_requests(spark, sf_dir), _entries(spark, sf_dir))
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"), "cached_type", "accepted", "reason")


@register("store_eviction", """
    SELECT vec_id AS seq, label FROM embeddings
    WHERE label NOT IN (2, 7) AND (vec_id * 7 % 100) / 100.0 >= 0.8
    ORDER BY seq DESC LIMIT 64""")
def store_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of one verdict per vector into a store of 64: FIFO, typed, confident."""
    rows = _with_type(inputs.table(spark, sf_dir, "embeddings"), "kind")
    confidence = ((F.col("vec_id") * 7 % 100) / 100.0).cast("string")
    verdict = F.struct(*[
        {"attack_type": F.col("kind"), "confidence": confidence, "label": F.col("label")}
        .get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VERDICT.fields])
    fresh = rows.select(F.col("vec_id").cast("string").alias("canonical_key"), verdict.alias("verdict"),
                        F.col("vec_id").alias("line_number"), "embedding",
                        F.array().cast("array<string>").alias("matched_rules"))
    empty = spark.createDataFrame([], verdict_store.ENTRIES)
    kept = reuse.admit_entries(empty, fresh, max_size=64)
    return kept.select("seq", F.col("verdict.label").alias("label"))


# --- exact reuse: verdicts given to errors are the store, all other events look up ---

_STORED = f"""SELECT canonical_key, arg_max(kind, line_number) AS cached_type, max(line_number) AS stored_line
  FROM (SELECT k.canonical_key, k.line_number, {type_name('v_attack_type')} AS kind
        FROM contexts k JOIN judged j USING (line_number) WHERE k.event_type = 'error') GROUP BY canonical_key"""


def _keyed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.with_context(inputs.with_verdicts(inputs.flagged(spark, sf_dir)))


def _stored(keyed: DataFrame) -> DataFrame:
    return reuse.admit_exact(keyed.filter(F.col("event_type") == "error"))


@register("exact_admission", statement(
    "SELECT canonical_key, cached_type, stored_line FROM stored", "contexts", "judged", extra={"stored": _STORED}))
def exact_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(_keyed_verdicts(spark, sf_dir)).select(
        "canonical_key", policy.attack_type_name(F.col("verdict.attack_type")).alias("cached_type"),
        F.col("line_number").alias("stored_line"))


@register("exact_lookup", statement(
    f"""SELECT line_number, cached_type AS exact_type,
      CASE WHEN cached_type IS NOT NULL THEN {compatible('context_type', 'cached_type')} END AS exact_ok
    FROM contexts LEFT JOIN stored USING (canonical_key) WHERE event_type <> 'error'""",
    "contexts", "judged", extra={"stored": _STORED}))
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed_verdicts(spark, sf_dir)
    return reuse.exact_lookup(keyed.filter(F.col("event_type") != "error"), _stored(keyed)).select(
        "line_number", "exact_type", "exact_ok")


@register("verdict_store_round_trip", statement(
    f"""SELECT canonical_key, arg_max(kind, line_number) AS cached_type
    FROM (SELECT k.canonical_key, k.line_number, {type_name('v_attack_type')} AS kind
          FROM contexts k JOIN judged j USING (line_number)) GROUP BY canonical_key""", "contexts", "judged"))
def verdict_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches written to a store on disk, read back as the latest per key."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4()}"
    keyed = cut_lineage(_keyed_verdicts(spark, sf_dir))
    empty = spark.createDataFrame([], verdict_store.ENTRIES)
    half = keyed.agg((F.max("line_number") / 2).alias("h")).scalar()
    early = keyed.filter(F.col("line_number") <= half)
    late = keyed.filter(F.col("line_number") > half)
    verdict_store.write_store(path, reuse.admit_exact(early), empty, 1)
    verdict_store.write_store(path, reuse.admit_exact(late), empty, 2)
    exact, _ = verdict_store.read_store(spark, path)
    return exact.select("canonical_key", policy.attack_type_name(F.col("verdict.attack_type")).alias("cached_type"))


@register("batch_exact_hits", statement(
    """SELECT line_number, coalesce(lag(context_type) OVER (PARTITION BY canonical_key ORDER BY line_number) = context_type, FALSE)
      AS exact_hit FROM contexts""", "contexts"))
def batch_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.batch_exact_hits(inputs.contexts(spark, sf_dir), bucket_lines=1000).select("line_number", "exact_hit")


# verdict type of a class: mostly its own context, sometimes another or unusable
_OWN = """CASE WHEN length(canonical_key || context_type) % 5 = 0 THEN 'csrf'
  WHEN length(canonical_key || context_type) % 5 = 1 THEN 'normal' ELSE context_type END"""



def _fold_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = cut_lineage(inputs.contexts(spark, sf_dir).select(*reuse.CLASS, "line_number"))
    classes = events.groupBy(*reuse.CLASS).agg(F.min("line_number").alias("first_line")).withColumns({
        "verdict_type": F.expr(_OWN),
        "exact_ok": F.expr("CASE WHEN length(canonical_key) % 4 = 0 THEN context_type IN ('sqli', 'cve') END"),
        "accepted": F.expr("length(canonical_key) % 3 = 0 AND context_type = 'xss'")})
    return events, reuse.number_classes(classes)


@register("batch_reuse_replay", statement(
    f"""SELECT line_number, outcome FROM walk""", "contexts", extra={
        "ordered": f"""SELECT line_number, canonical_key, context_type AS ctx, {_OWN} AS own,
            length(canonical_key) % 4 = 0 AND context_type IN ('sqli', 'cve') AS store_fits,
            length(canonical_key) % 3 = 0 AND context_type = 'xss' AS near,
            row_number() OVER (PARTITION BY canonical_key ORDER BY line_number) AS rn FROM contexts""",
        "walk": f"""SELECT * FROM (WITH RECURSIVE w AS (
            SELECT line_number, canonical_key, rn, CASE WHEN store_fits THEN 'exact' WHEN near THEN 'semantic' ELSE 'miss' END AS outcome,
              CASE WHEN store_fits OR near THEN NULL ELSE own END AS state FROM ordered WHERE rn = 1
            UNION ALL
            SELECT line_number, canonical_key, rn, outcome, CASE WHEN outcome = 'miss' THEN own ELSE state END FROM (
              SELECT o.line_number, o.canonical_key, o.rn, o.own, w.state,
                CASE WHEN CASE WHEN w.state IS NULL THEN o.store_fits ELSE {compatible('o.ctx', 'w.state')} END THEN 'exact'
                     WHEN o.near THEN 'semantic' ELSE 'miss' END AS outcome
              FROM w JOIN ordered o ON o.canonical_key = w.canonical_key AND o.rn = w.rn + 1))
          SELECT * FROM w)"""}))
def batch_reuse_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-dependent reuse inside a batch, in the general form."""
    events, classes = _fold_inputs(spark, sf_dir)
    return reuse.fold_reuse(events, classes, bucket_lines=5000).select("line_number", "outcome")


@register("lookup_outcomes", statement(
    f"""SELECT line_number, CASE WHEN ok THEN 'exact' ELSE 'miss' END AS hit_type, ok AS hit,
      CASE WHEN ok THEN 'exact_canonical_key' ELSE 'empty_cache' END AS reason,
      CASE WHEN cached_type IS NOT NULL AND NOT ok THEN 1 ELSE 0 END AS rejects
    FROM (SELECT *, coalesce({compatible('context_type', 'cached_type')}, FALSE) AS ok
          FROM contexts LEFT JOIN stored USING (canonical_key))""", "contexts", "judged", extra={"stored": _STORED}))
def lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flagged events against a store with exact verdicts but no entries."""
    keyed = cut_lineage(_keyed_verdicts(spark, sf_dir))
    empty = spark.createDataFrame([], verdict_store.ENTRIES)
    classes = keyed.select(*reuse.CLASS).distinct()
    found = reuse.lookup_classes(classes, _stored(keyed), empty, reuse.HashedNgrams(64))
    outcomes = reuse.lookup_outcome(found).select(*reuse.CLASS, "hit_type", "hit", "reason", "rejects")
    return keyed.join(outcomes, reuse.CLASS).select("line_number", "hit_type", "hit", "reason", "rejects")


_REQUESTS = f"""SELECT *, has_exact AND {compatible('context_type', 'exact_type')} AS exact_ok FROM (SELECT vec_id, array_to_string(embedding, ',') AS canonical_key, label % 5 = vec_id % 5 AS has_exact,
    ({list(_TYPES)})[vec_id * 3 % {len(_TYPES)} + 1] AS exact_type, {context_type(f"[({list(_TYPES)})[label + 1]]")} AS context_type,
    embedding::DOUBLE[] AS embedding, ({list(_TYPES)})[label + 1] AS attack_type, (vec_id * 7 % 100) / 100.0::DOUBLE AS confidence FROM embeddings)"""


def _vector_of_key():
    """The vector that a key spells out."""
    return lambda keys: [[float(x) for x in key.split(",")] for key in keys]


@register("lookup_all_outcomes", statement(
    f"""SELECT vec_id, hit_type, hit_type IN ('exact', 'semantic') AS hit,
      CASE WHEN hit_type = 'exact' THEN 'exact_canonical_key' ELSE near_reason END AS reason,
      CASE WHEN has_exact AND NOT exact_ok THEN 1 ELSE 0 END + CASE WHEN hit_type = 'rejected' THEN 1 ELSE 0 END AS rejects
    FROM (SELECT *, CASE WHEN exact_ok THEN 'exact' WHEN accepted THEN 'semantic' ELSE 'rejected' END AS hit_type
      FROM (SELECT r.vec_id, r.has_exact, r.exact_ok,
          {decision("e.attack_type", "e.attack_type", "e.confidence", "n.similarity", "r.context_type", "r.context_type")[0]} AS accepted,
          {decision("e.attack_type", "e.attack_type", "e.confidence", "n.similarity", "r.context_type", "r.context_type")[1]} AS near_reason
        FROM requests r JOIN nearest n USING (vec_id) JOIN requests e ON e.vec_id = n.best_seq))""", extra={"requests": _REQUESTS, "nearest": """
        SELECT r.vec_id, arg_max(e.vec_id, {'s': list_dot_product(r.embedding, e.embedding), 'q': -e.vec_id}) AS best_seq,
          max(list_dot_product(r.embedding, e.embedding)) AS similarity
        FROM requests r, requests e WHERE e.vec_id % 3 > 0 GROUP BY r.vec_id"""}))
def lookup_all_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a request against a store of exact verdicts and of two thirds of the vectors: stored ones meet
    themselves, the others their nearest, so that exact, semantic and rejected outcomes all occur."""
    rows = cut_lineage(_with_type(inputs.table(spark, sf_dir, "embeddings"), "attack_type").withColumns({
        "canonical_key": F.array_join(F.col("embedding").cast("array<string>"), ","),
        "context_type": policy.context_type(F.array("attack_type")),
        "exact_type": F.get(F.array(*[F.lit(t) for t in _TYPES]), (F.col("vec_id") * 3 % len(_TYPES)).cast("int"))}))
    kind = lambda column: F.struct(*[(F.col(column) if f.name == "attack_type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in VERDICT.fields])
    exact = rows.filter("label % 5 = vec_id % 5").select("canonical_key", kind("exact_type").alias("verdict"))
    entries = rows.filter("vec_id % 3 > 0").select(
        "canonical_key", "embedding", kind("attack_type").alias("verdict"), "attack_type", F.col("attack_type").alias("rule_family"),
        ((F.col("vec_id") * 7 % 100) / 100.0).alias("confidence"), F.col("vec_id").alias("seq"))
    classes = rows.select("vec_id", "canonical_key", "context_type", F.col("context_type").alias("context_family"))
    found = reuse.lookup_outcome(reuse.lookup_classes(classes, exact, entries, _vector_of_key))
    return found.select("vec_id", "hit_type", "hit", "reason", "rejects")


@register("reuse_statistics", statement(
    f"""SELECT count(*) AS lookups, count(*) FILTER (WHERE ok) AS hits,
      count(*) FILTER (WHERE cached_type IS NOT NULL AND NOT ok) AS semantic_rejects,
      count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS hit_rate, 0 AS size
    FROM (SELECT *, coalesce({compatible('context_type', 'cached_type')}, FALSE) AS ok
          FROM contexts LEFT JOIN stored USING (canonical_key))""", "contexts", "judged", extra={"stored": _STORED}))
def reuse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.reuse_stats(lookup_outcomes(spark, sf_dir))


@register("key_embeddings", statement(
    """SELECT canonical_key, 64 AS dims, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS squared_norm,
      round(list_sum(list_transform(e, lambda x, i: x * i)), 3) AS weighted_sum FROM unit""", "contexts", extra={
        "padded": "SELECT canonical_key, ' ' || canonical_key || ' ' AS p FROM (SELECT DISTINCT canonical_key FROM contexts)",
        "places": """SELECT canonical_key, list_transform(range(1, greatest(length(p) - 2, 1) + 1),
          lambda i: CAST('0x' || left(md5(substr(p, i, 3)), 7) AS INTEGER) % 64) AS places FROM padded""",
        "counts": """SELECT canonical_key, list_transform(range(0, 64), lambda d: len(list_filter(places, lambda x: x = d))) AS n FROM places""",
        "unit": """SELECT canonical_key, list_transform(n, lambda c: ((c / sqrt(list_sum(list_transform(n, lambda m: m * m))))::FLOAT)::DOUBLE) AS e
          FROM counts"""}))
def key_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = inputs.contexts(spark, sf_dir).select("canonical_key").distinct()
    embedded = reuse.embed_keys(distinct, reuse.HashedNgrams(64))
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    places = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return embedded.select("canonical_key", F.size("embedding").alias("dims"), F.round(norm, 4).alias("squared_norm"),
                           F.round(F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x), 3).alias("weighted_sum"))


@register("store_after_clear", statement(
    f"""SELECT canonical_key, arg_max(kind, line_number) AS cached_type
    FROM (SELECT k.canonical_key, k.line_number, {type_name('v_attack_type')} AS kind
          FROM contexts k JOIN judged j USING (line_number)
          WHERE k.line_number > (SELECT max(line_number) / 2 FROM judged)) GROUP BY canonical_key""", "contexts", "judged"))
def store_after_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before the store was cleared is forgotten, what comes after is there."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4()}"
    keyed = cut_lineage(_keyed_verdicts(spark, sf_dir))
    empty = spark.createDataFrame([], verdict_store.ENTRIES)
    half = keyed.agg((F.max("line_number") / 2).alias("h")).scalar()
    verdict_store.write_store(path, reuse.admit_exact(keyed.filter(F.col("line_number") <= half)), empty, 1)
    verdict_store.clear_store(spark, path)
    verdict_store.write_store(path, reuse.admit_exact(keyed.filter(F.col("line_number") > half)), empty, 2)
    exact, _ = verdict_store.read_store(spark, path)
    return exact.select("canonical_key", policy.attack_type_name(F.col("verdict.attack_type")).alias("cached_type"))
