"""Attack-type names, rule families, confidence, risk and the reuse decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.text import lookup, strip


def attack_type_name(value: Column) -> Column:
    """One spelling per attack type; NULL and empty are ``unknown``."""
    name = strip(F.lower(F.when(value == "", F.lit("unknown")).otherwise(
        F.coalesce(value, F.lit("unknown")))))
    return lookup(name, config.ATTACK_TYPE_ALIASES, name)


def context_type(attack_types: Column) -> Column:
    """The first attack type that says something, else ``unknown``."""
    named = F.transform(F.coalesce(attack_types, F.array().cast("array<string>")), attack_type_name)
    telling = F.filter(named, lambda t: ~t.isin("", "unknown", "normal"))
    return F.coalesce(F.get(telling, F.lit(0)), F.lit("unknown"))


def rule_family(attack_type: Column, matched_rules: Column) -> Column:
    """The family named by the first rule that names one, else the attack type."""
    def family(rule: Column) -> Column:
        low = F.lower(rule)
        out = None
        for name in config.RULE_FAMILIES:
            hit = F.contains(low, F.lit(name))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.when(F.contains(low, F.lit("path_traversal")), "lfi")

    families = F.array_compact(F.transform(
        F.coalesce(matched_rules, F.array().cast("array<string>")), family))
    return F.coalesce(F.get(families, F.lit(0)), attack_type)


def risk_score(context_risk: Column, verdict_risk: Column, severity: Column) -> Column:
    """The context's risk, else the verdict's, else one from the severity."""
    from_severity = lookup(F.lower(severity), config.SEVERITY_RISK, F.lit(config.DEFAULT_RISK))
    return F.coalesce(context_risk.cast("double"), verdict_risk.try_cast("double"), from_severity)


def type_threshold(attack_type: Column) -> Column:
    return lookup(attack_type, config.SIMILARITY_BY_TYPE, F.lit(config.DEFAULT_SIMILARITY))


def exact_compatible(context: Column, cached_type: Column, has_context: bool = True) -> Column:
    """Whether a verdict stored under the same key may be used for this context."""
    if not has_context:
        return F.lit(True)
    return F.when(context == "unknown", cached_type.isin("unknown", "normal")).otherwise(
        context == cached_type)


def similarity_decision(cached_type: Column, cached_family: Column, confidence: Column,
                        similarity: Column, context: Column, context_family: Column,
                        has_context: bool = True) -> Column:
    """Struct ``(accepted, reason)`` for the most similar stored verdict: one
    ordered CASE, the first condition that holds decides. ``context_family`` is
    ``rule_family`` of the context."""
    threshold = type_threshold(F.when(context != "unknown", context).otherwise(cached_type))
    shown = F.format_string("%.2f", threshold)

    def verdict(accepted: bool, *reason: Column | str) -> Column:
        text = F.concat(*[r if isinstance(r, Column) else F.lit(r) for r in reason])
        return F.struct(F.lit(accepted).alias("accepted"), text.alias("reason"))

    decision = (
        F.when(cached_type.isin(*config.EXACT_ONLY_TYPES),
               verdict(False, "cached_type_exact_only:", cached_type))
        .when(confidence < config.MIN_REUSE_CONFIDENCE,
              verdict(False, f"cached_confidence_below_{config.MIN_REUSE_CONFIDENCE}"))
        .when(similarity < threshold, verdict(False, "similarity<", shown))
    )
    if not has_context:
        return decision.otherwise(verdict(True, "legacy_no_context similarity>=", shown))
    return (
        decision
        .when(context == "unknown", verdict(False, "unknown_context_no_semantic_reuse"))
        .when(context == cached_type,
              verdict(True, "same_attack_type:", cached_type, " similarity>=", shown))
        .when(context_family != cached_family,
              verdict(False, "attack_type_mismatch:", context, "!=", cached_type))
        .otherwise(verdict(True, "same_rule_family:", cached_family, " similarity>=", shown))
    )
