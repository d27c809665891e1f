"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.llm import bpe, decontaminate, negatives, neighbours, packing, pii, quality, secrets, sharding, simhash, toolcalls, topk, whitening
from hedgewatch.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file: beside its installed index module, or in $TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op4_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "size", "text_crc32", "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=cut_lineage)


@query
def op10_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every(table(spark, sf_dir, "embeddings"))


ORACLES["op10_kd_tree_top_k"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after replacement and what was replaced in it."""
    replaced = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), report="replaced")
    return replaced.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"), F.array_join(F.transform(
        "replaced", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",").alias("spans"))


@query
def op8_nn_descent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op8_nn_descent_duplicates"] = """
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
    usable AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v
               WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
    link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q
             ON p.vec_id <> q.vec_id AND list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.9),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, min(reach.b) AS component_id,
           v.vec_id = min(reach.b) AS kept
    FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id"""


#: Tools that the conversations' turns are read as calls of.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "note": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "maxLength": 400}, "turn": {"type": "integer"}}},
    "lookup": {"type": "object", "required": ["keys"], "properties": {"keys": {"type": "array", "items": {"type": "string"}}}},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as the turns of conversations have them.

    An assistant's turn is a call whose arguments hold the whole text of its turn; it may need the call before it, or after it. Any
    other turn is the result of the assistant's turn before it, or, where there is none, of a call that does not exist.
    """
    def call_id(turn: str) -> str:
        return f"concat('call_', substring(md5(concat_ws(':', conv_id, {turn})), 1, 12))"

    own = "conv_id IS NOT NULL AND turn IS NOT NULL"
    calls = conversations.where(f"role = 'assistant' AND {own}").selectExpr(
        "conv_id", "turn", f"{call_id('turn')} AS call_id", "element_at(array('search', 'note', 'lookup', 'erase'), CAST(pmod(conv_id + turn, 4) AS INT) + 1) AS name",
        """CASE pmod(conv_id + turn, 4) WHEN 0 THEN to_json(named_struct('query', text, 'limit', pmod(conv_id * 7 + turn, 60)))
                WHEN 1 THEN to_json(named_struct('turn', IF(conv_id % 5 = 0, NULL, turn), 'text', text))
                WHEN 2 THEN to_json(named_struct('keys', split(text, ' '))) ELSE text END AS arguments""",
        f"""CASE WHEN pmod(conv_id + turn, 3) = 0 THEN array({call_id('turn - 2')})
                 WHEN pmod(conv_id + turn, 11) = 5 THEN array({call_id('turn + 2')}) ELSE array() END AS after""")
    results = conversations.where(f"role <> 'assistant' AND {own}").selectExpr("conv_id", "turn", f"{call_id('turn - 1')} AS call_id", "text AS content")
    return calls, results


@query
def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = toolcalls.link_calls(*conversation_calls(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.withColumn("problems", F.array_join("problems", "; "))


@query
def op11_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op11_suffix_automaton_decontamination"] = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    passage AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
                FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
    gram AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
             FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
    found AS (SELECT doc_id, p, n, item_id FROM gram JOIN passage USING (n, g)),
    word AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM found) GROUP BY doc_id),
    item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
             FROM found GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""


@query
def op12_householder_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    parts = F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained")
    return rows.where(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", F.inline(parts)).select(
        "vec_id", F.col("component").cast("int").alias("component"), "n", "deviation", "whitened", "explained", "identity_error")


@query
def op13_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.mine(negatives.usable_rows(rows))


ORACLES["op13_bond_hard_negatives"] = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
               FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    ranked AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                      CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
               FROM positive JOIN scored USING (anchor_id)
               WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
