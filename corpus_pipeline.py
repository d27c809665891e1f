"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; ``run`` writes
every stage's result as Parquet and reads it again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch.llm import packing, pii, quality, simhash
from hedgewatch.llm.common import quoted, unused
from hedgewatch.llm.queries import table, tokenizer_file
from hedgewatch.session import checkpoint_dir, cut_lineage

#: Labelled documents that the quality model is fitted on, at most: the smallest by a hash of doc_id.
TRAINING_ROWS = 50_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model is fitted on labelled documents of this stage's own input, at most ``TRAINING_ROWS`` of them; the
    score that rejects is the production one, of the whole text. Null and empty texts are scored as empty; documents of equal text have equal scores.
    Where the labels hold fewer than two of these documents for a class, there is no model to reject by: all documents stay, with a
    warning. Columns of any name pass through."""
    marks = quality.training_labels(table(spark, sf_dir, "labels"), TRAINING_ROWS)
    labelled = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most TRAINING_ROWS pairs of numbers
    model = quality.fit(labelled, text_col="text")
    if model.constant_score is not None:
        logging.getLogger(__name__).warning("too few labels of a class: no document is rejected")
        return docs
    return docs.where(quality.text_score(model) >= quality.REJECT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (rows without come last);
    of rows that agree in it, the one whose text has the smallest digest, once. Null and empty texts are near each other. Columns of any
    name pass through."""
    name = unused(docs.columns, "_key")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                   F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("digest"))
    keyed = docs.withColumn(name, key)
    named = simhash.near_duplicates(keyed, id_col=name).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(cut_lineage(named), name, "left_semi").dropDuplicates([name]).select(*map(quoted, docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in texts get surrogates; n_chars follows the new text where it was given. Null, empty and clean texts, and columns of any
    name, stay as they were."""
    drawn = unused(docs.columns, "_drawn")
    replaced = pii.replace_entities(docs, report=drawn)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.when(F.size(drawn) > 0, F.char_length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return replaced.select(*map(quoted, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset. A null or empty text is one piece of one id; repeated rows give repeated
    pieces; of the columns only doc_id and text are looked at; an empty table gives no pieces."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("near-duplicates", near_duplicate_stage), ("personal data", pii_stage), ("packing", packing_stage)]
#: Merge rounds, XXH64 shingles and keyed draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
