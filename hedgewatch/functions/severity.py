"""Severity names and the score fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.text import lookup, strip


def severity_name(value: Column) -> Column:
    """A known severity, or NULL."""
    names = {s: s for s in config.SEVERITIES} | config.SEVERITY_ALIASES
    return lookup(F.lower(strip(value.cast("string"))), names)


def score_severity(score: Column) -> Column:
    out = None
    for name, floor in config.SEVERITY_FLOORS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise("low")


def alert_severity(severity: Column, verdict_severity: Column, merged_score: Column) -> Column:
    """The severity an alert is read with: its own, its verdict's, its score's."""
    return F.coalesce(severity_name(severity), severity_name(verdict_severity),
                      score_severity(F.coalesce(merged_score, F.lit(0.0))))
