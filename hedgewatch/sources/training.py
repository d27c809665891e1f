"""Training sets and saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.functions.text import strip_sql
from hedgewatch.operators.train import binary_label, training_text

EXAMPLE = ("method string, path string, query string, query_string string, content string, "
           "user_agent string, status string, status_code string, label int")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text, label)`` from JSON lines, one object per non-blank line. A line that is no JSON object stops the
    job, as does a label that is no whole number; a label may be written as text, number or boolean."""
    lines = spark.read.text(path).where(f"{strip_sql('value')} <> ''")
    return examples(parse_examples(lines))


def parse_examples(lines: DataFrame) -> DataFrame:
    """``value`` as JSON objects with the fields of ``EXAMPLE``; strict."""
    parsed = lines.select("value", F.from_json("value", EXAMPLE.replace("label int", "label string") + ", _broken string",
                                               {"columnNameOfCorruptRecord": "_broken"}).alias("row"))
    whole = F.col("value").rlike(r"^\s*\{") & F.col("row").isNotNull() & F.col("row._broken").isNull()
    text = F.lower(F.trim("row.label"))
    label = F.when(text == "true", 1).when(F.coalesce(text, F.lit("")).isin("false", ""), 0).otherwise(text.try_cast("double").cast("int"))
    fail = lambda message: F.raise_error(F.concat(F.lit(message), F.left("value", F.lit(200))))
    names = [c.split(" ")[0] for c in EXAMPLE.split(", ") if not c.startswith("label")]
    row = F.when(~whole, fail("not a JSON object: ").cast("int")).otherwise(F.coalesce(label, fail("not a label: ").cast("int")))
    return parsed.select(*[F.col(f"row.{n}").alias(n) for n in names], row.alias("label"))


def examples(rows: DataFrame) -> DataFrame:
    """Labelled requests to ``(id, text, label)``; the id is the row's
    position in the read."""
    return rows.select(
        F.monotonically_increasing_id().alias("id"),
        training_text(rows.columns).alias("text"),
        binary_label(F.col("label")).alias("label"))


def save_model(model: PipelineModel, metrics: DataFrame, path: str, source_dataset: str = "") -> None:
    """Write the model and, next to it, one row of metadata. The threshold is kept
    for reference; scoring does not use it."""
    model.write().overwrite().save(f"{path}/model")
    metrics.withColumns({
        "taxonomy": F.array(F.lit("normal"), F.lit("attack")),
        "source_dataset": F.lit(source_dataset),
    }).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata")
