"""Serving text, score merge and flagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.text import non_empty


def serving_text(columns: list[str], agent_chars: int | None = None) -> Column:
    """Text a request is scored on: path, then query, content and user agent where
    not empty, whole by default; ``agent_chars`` keeps the agent's head only
    (``config.SERVING_AGENT_CHARS`` is the usual figure). Training uses a different text, see
    ``operators.train.training_text``."""
    def part(name: str) -> Column:
        return non_empty(F.col(name)) if name in columns else F.lit(None).cast("string")
    return F.concat_ws(
        " ", F.coalesce(F.col("path"), F.lit("")), part("query_string"), part("content"),
        part("user_agent") if agent_chars is None else F.left(part("user_agent"), F.lit(agent_chars)))


def merged_score(rule_score: Column, content_score: Column) -> Column:
    """Weighted mean of both scores, but never below the content floor."""
    weight = config.CONTENT_WEIGHT + config.RULE_WEIGHT
    mean = (config.CONTENT_WEIGHT * content_score + config.RULE_WEIGHT * rule_score) / weight
    return F.least(F.greatest(mean, content_score * config.CONTENT_FLOOR_FACTOR), F.lit(1.0))


def merge_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("merged_score", merged_score(F.col("rule_score"), F.col("ml_score")))


def merge_and_flag(df: DataFrame, threshold: float = config.ALERT_THRESHOLD) -> DataFrame:
    """Flagged events only, with ``merged_score`` and ``flagged``."""
    return merge_scores(df).filter(F.col("merged_score") >= threshold).withColumn(
        "flagged", F.lit(True))


def choose_probability(probability: Column, classes: list | None) -> Column:
    """The attack probability from an array of class probabilities.

    With a class list: that of class 1, else one minus that of class 0, else the
    largest. Without: the second of two, else one minus the first.
    """
    if classes is not None:
        if 1 in classes:
            return probability[classes.index(1)]
        if 0 in classes:
            return 1.0 - probability[classes.index(0)]
        return F.array_max(probability)
    return F.when(F.size(probability) == 2, probability[1]).otherwise(1.0 - probability[0])
