"""From flagged events to alerts: lookups, verdicts, in-batch reuse, admission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.policy import attack_type_name
from hedgewatch.functions.verdict import fallback_verdict
from hedgewatch.operators.alerts import build_alerts
from hedgewatch.operators.reuse import (
    BUCKET_LINES, CLASS, Embedder, HashedNgrams, admit_entries, admit_exact, count_hits, join_dealt,
    fold_reuse, lookup_classes, number_classes, with_context,
)
from hedgewatch.operators.verdicts import Provider, infer_verdicts, parse_verdict, with_request
from hedgewatch.session import cut_lineage

REQUEST_FIELDS = ("method", "path", "query_string", "user_agent", "status_code", "merged_score",
                  "rule_score", "ml_score", "attack_types", "matched_rules", "source")


@dataclass
class BatchResult:
    alerts: DataFrame
    outcomes: DataFrame
    new_exact: DataFrame | None
    entries: DataFrame | None


def _ask(requests: DataFrame, provider: Provider | None, journal: str | None) -> DataFrame:
    """``verdict`` for every row; answers are written before anything uses them, so
    no later task retry asks again."""
    if provider is None:
        return requests.withColumn("verdict", fallback_verdict())
    return parse_verdict(cut_lineage(infer_verdicts(with_request(requests), provider, journal=journal).drop(
        "event_summary", "context_summary")))


def without_reuse(flagged: DataFrame, provider: Provider | None, journal: str | None = None) -> BatchResult:
    """Every flagged event gets a verdict of its own."""
    asked = _ask(flagged, provider, journal).withColumn("cache_hit", F.lit(False))
    return BatchResult(build_alerts(asked), asked.select("line_number", F.lit("miss").alias("outcome")),
                       None, None)


def with_reuse(flagged: DataFrame, exact: DataFrame, entries: DataFrame,
               provider: Provider | None = None, embedder: Embedder | None = None,
               max_size: int = config.STORE_MAX_ENTRIES,
               bucket_lines: int = BUCKET_LINES, journal: str | None = None) -> BatchResult:
    """Resolve a batch of flagged events (a written table) against a store.

    Similarity reuse sees the entries of earlier batches only; exact reuse works
    inside the batch too, in line order. A verdict is asked for once per class.
    """
    events = flagged if set(CLASS) <= set(flagged.columns) else with_context(flagged)
    classes = number_classes(events.groupBy(*CLASS).agg(
        F.min("line_number").alias("first_line"),
        F.min_by(F.struct(*REQUEST_FIELDS), "line_number").alias("request_of")))
    found = cut_lineage(lookup_classes(classes, exact, entries, embedder or HashedNgrams()))

    settled = F.coalesce("exact_ok", F.lit(False)) | F.col("accepted")
    changing = found.filter(~settled).select("canonical_key").distinct()
    needed = found.filter(~F.col("accepted")).join(changing, "canonical_key", "left_semi").select(
        *CLASS, "request_of.*")
    verdicts = _ask(needed, provider, journal).select(*CLASS, "verdict")
    known = found.join(verdicts, CLASS, "left").withColumn(
        "verdict_type", attack_type_name(F.col("verdict.attack_type")))

    folded = fold_reuse(events, known, bucket_lines)
    source = known.select(
        "canonical_key", F.col("class_no").alias("used"), "verdict", "verdict_type", "exact_verdict",
        "exact_type", "near_verdict", "similarity", "cached_type", "reason", "embedding",
        "best_seq")
    used = F.when(F.col("state") > 0, F.col("state")).otherwise(F.col("class_no"))
    resolved = join_dealt(folded.withColumn("used", used), source, ["canonical_key", "used"], bucket_lines)

    stored = (F.col("outcome") == "exact") & (F.col("state") == 0)
    is_exact, is_near = F.col("outcome") == "exact", F.col("outcome") == "semantic"
    # written once: alerts, exact verdicts and entries all start from these rows
    resolved = cut_lineage(resolved.withColumns({
        "verdict": F.when(stored, F.col("exact_verdict")).when(is_near, F.col("near_verdict"))
                    .otherwise(F.col("verdict")),
        "cache_hit": is_exact | is_near,
        "cache_hit_type": F.col("outcome"),
        "cache_similarity": F.when(is_exact, F.lit(1.0)).otherwise(F.col("similarity")),
        "cached_attack_type": F.when(stored, F.col("exact_type")).when(is_exact, F.col("verdict_type"))
                               .otherwise(F.col("cached_type")),
        "cache_decision_reason": F.when(is_exact, "exact_canonical_key").otherwise(F.col("reason")),
        "cache_policy_mode": F.lit(config.POLICY_MODE),
    }).drop("near_verdict", "exact_verdict"))
    asked = resolved.filter(F.col("outcome") == "miss").select(
        "canonical_key", "verdict", "line_number", "embedding", "matched_rules")
    hit_entries = resolved.filter(is_near).select(F.col("best_seq").alias("seq"))
    return BatchResult(
        alerts=build_alerts(resolved),
        outcomes=resolved.select("line_number", "canonical_key", "outcome", "cache_similarity",
                                 "cached_attack_type", "cache_decision_reason"),
        new_exact=admit_exact(asked),
        entries=admit_entries(count_hits(entries, hit_entries), asked, max_size),
    )
