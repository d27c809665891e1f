"""Content model: registered queries over documents and their labels."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.checks import inputs
from hedgewatch.checks.registry import register
from hedgewatch.checks.sql import statement
from hedgewatch.operators import tfidf, train
from hedgewatch.session import checkpoint_dir, cut_lineage
from hedgewatch.sources import training

# word by word: sizes up to the padded word's length, positions within it
_GRAMS = """SELECT doc_id, substr(w, p, n) AS term FROM (
    SELECT doc_id, w, n, unnest(range(1, greatest(2, length(w) - n + 2))) AS p FROM (
      SELECT doc_id, w, unnest(range(2, least(5, length(w)) + 1)) AS n FROM (
        SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w
        FROM documents)))"""
_COUNTS = "SELECT doc_id, term, count(*) AS c FROM grams GROUP BY doc_id, term"
_VOCAB = """SELECT term, df, total, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1 AS idf,
    row_number() OVER (ORDER BY term) - 1 AS "index" FROM (
      SELECT term, count(*) AS df, sum(c)::BIGINT AS total FROM counts GROUP BY term HAVING count(*) >= 2
      ORDER BY total DESC, term LIMIT 50000)"""
_STAGES = {"grams": _GRAMS, "counts": _COUNTS, "vocab": _VOCAB}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), inputs.DOCUMENT_ROWS)


@register("word_ngrams", statement(
    "SELECT doc_id, count(*) AS terms, sum(c)::BIGINT AS total, max(c) AS most, min(term) AS first FROM counts GROUP BY doc_id",
    extra={k: _STAGES[k] for k in ("grams", "counts")}))
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tfidf.term_lists(_documents(spark, sf_dir), "doc_id", "text").select(
        "doc_id", F.size("terms").alias("terms"), F.aggregate("counts", F.lit(0).cast("bigint"), lambda n, c: n + c).alias("total"),
        F.array_max("counts").alias("most"), F.array_min("terms").alias("first"))
    return listed.groupBy("doc_id").agg(
        F.sum("terms").alias("terms"), F.sum("total").alias("total"), F.max("most").alias("most"), F.min("first").alias("first"))


@register("tfidf_vocabulary", statement(
    'SELECT term, df, total, round(idf, 8) AS idf, "index" FROM vocab', extra=_STAGES))
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = tfidf.tfidf_vocab(_documents(spark, sf_dir), "text")
    return vocab.select("term", "df", "total", F.round("idf", 8).alias("idf"), "index")


@register("tfidf_weights", statement(
    """SELECT w.doc_id, count(*) AS terms, round(max(w / norm), 6) AS largest, round(sum(w / norm), 4) AS sum_weights,
      round(sum((w / norm) * (w / norm)), 6) AS squared_norm FROM weighted w
      JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY doc_id) n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    extra={**_STAGES, "weighted": "SELECT doc_id, term, (ln(c) + 1) * idf AS w FROM counts JOIN vocab USING (term)"}))
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    vocab = cut_lineage(tfidf.tfidf_vocab(docs, "text"))
    weights = train.tfidf_weights(docs, "text", vocab)
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("largest"),
        F.round(F.sum("weight"), 4).alias("sum_weights"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared_norm"))


@register("training_text", statement(
    """SELECT line_number, concat_ws(' ', coalesce(method, ''), coalesce(path, ''), coalesce(query_string, ''), '',
      coalesce(user_agent, ''), status_code::VARCHAR) AS text FROM log""", "log"))
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.access_log(spark, sf_dir)
    return log.select("line_number", train.training_text(log.columns).alias("text"))


@register("binary_labels", "SELECT doc_id, CASE WHEN coalesce(toxic, 0) > 0 THEN 1 ELSE 0 END AS label FROM labels")
def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "labels").select("doc_id", train.binary_label(F.col("toxic")).alias("label"))


@register("stratified_split", """
    SELECT toxic AS label, count(*) AS examples, round(count(*) * 0.15)::BIGINT AS validation FROM labels GROUP BY toxic""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return train.stratified_split(rows, "doc_id").groupBy("label").agg(
        F.count("*").alias("examples"), F.count_if("validation").alias("validation"))


@register("class_weights", """
    SELECT toxic AS label, (SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)) AS weight
    FROM labels GROUP BY toxic""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.class_weights(inputs.table(spark, sf_dir, "labels").select(F.col("toxic").alias("label")))


_SCORED = """SELECT quality AS label, (n_chars % 1009) / 1009.0::DOUBLE * 0.7 + quality * 0.2 AS score
  FROM documents JOIN labels USING (doc_id)"""
_SWEEP = """SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM (
    SELECT i, CASE WHEN i = 70 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE + i * ((0.9::DOUBLE - 0.2::DOUBLE) / 70) END AS threshold,
      count(*) FILTER (WHERE label = 1 AND score >= CASE WHEN i = 70 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE + i * ((0.9::DOUBLE - 0.2::DOUBLE) / 70) END) AS tp,
      count(*) FILTER (WHERE label <> 1 AND score >= CASE WHEN i = 70 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE + i * ((0.9::DOUBLE - 0.2::DOUBLE) / 70) END) AS fp,
      count(*) FILTER (WHERE label = 1 AND NOT score >= CASE WHEN i = 70 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE + i * ((0.9::DOUBLE - 0.2::DOUBLE) / 70) END) AS fn
    FROM scored_rows, range(0, 71) AS r(i) GROUP BY i)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.labelled_documents(spark, sf_dir).select(
        F.col("quality").alias("label"),
        ((F.col("n_chars") % 1009) / F.lit(1009.0) * 0.7 + F.col("quality") * 0.2).alias("score"))


@register("threshold_sweep", statement(
    "SELECT round(threshold, 6) AS threshold, round(f1, 9) AS f1 FROM sweep", extra={"scored_rows": _SCORED, "sweep": _SWEEP}))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.threshold_scores(_scored(spark, sf_dir)).select(
        F.round("threshold", 6).alias("threshold"), F.round("f1", 9).alias("f1"))


@register("best_threshold", statement(
    "SELECT round(threshold, 6) AS threshold, round(f1, 9) AS f1 FROM sweep ORDER BY sweep.f1 DESC, sweep.threshold LIMIT 1",
    extra={"scored_rows": _SCORED, "sweep": _SWEEP}))
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.best_threshold(_scored(spark, sf_dir)).select(
        F.round("threshold", 6).alias("threshold"), F.round("f1", 9).alias("f1"))


# Terms, depth and rate as by default. Rounds are fewer than the default 500: a round of the tree learner is some ten
# jobs, so that 500 take an hour or more in a check; see the README.
_PARAMS = train.TrainParams(rounds=10)
_LOG_TEXT = """SELECT line_number AS doc_id, concat_ws(' ', coalesce(method, ''), coalesce(path, ''), coalesce(query_string, ''), '',
    coalesce(user_agent, ''), status_code::VARCHAR) AS text FROM detected"""
_LOG_STAGES = {"log_text": _LOG_TEXT, "grams": _GRAMS.replace("FROM documents", "FROM log_text"), "counts": _COUNTS}


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame]:
    """A model of which flagged requests any rule matches."""
    log = inputs.detected(spark, sf_dir)
    examples = log.select(
        F.col("line_number").alias("id"), train.training_text(log.columns).alias("text"),
        F.col("matched").cast("int").alias("label"))
    return train.train(examples, _PARAMS)


@register("content_model_training", statement(
    """SELECT (SELECT count(*) FROM detected) AS samples, (SELECT least(50000, count(*)) FROM (
      SELECT term FROM counts GROUP BY term HAVING count(*) >= 2)) AS features, TRUE AS on_grid, TRUE AS f1_in_range""",
    "detected", extra=_LOG_STAGES))
def content_model_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes exactly; of the threshold and its F1, which depend on the learner, what must hold for any."""
    step = (F.col("threshold") - config.SWEEP_FROM) * ((config.SWEEP_STEPS - 1) / (config.SWEEP_TO - config.SWEEP_FROM))
    return _fitted(spark, sf_dir)[1].select(
        "samples", F.col("features").cast("bigint").alias("features"), (F.abs(step - F.round(step)) < 1e-6).alias("on_grid"),
        F.col("val_f1").between(0.5, 1.0).alias("f1_in_range"))


@register("content_scores", statement(
    "SELECT line_number, TRUE AS in_range, TRUE AS same_when_reloaded, TRUE AS matches_score_higher FROM log", "log"))
def content_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score a line, within 0 and 1, the same from the saved and reloaded model, and on average higher where a rule matches."""
    model, metrics = _fitted(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4()}"
    training.save_model(model, metrics, path)
    loaded, _ = training.load_model(spark, path)
    scored = cut_lineage(train.score(inputs.detected(spark, sf_dir), model).select("line_number", "matched", "ml_score"))
    again = train.score(inputs.access_log(spark, sf_dir), loaded).select("line_number", F.col("ml_score").alias("again"))
    higher = scored.agg((F.avg(F.when(F.col("matched"), F.col("ml_score"))) > F.avg(F.when(~F.col("matched"), F.col("ml_score")))).alias("h")).scalar()
    return scored.join(again, "line_number").select(
        "line_number", F.col("ml_score").between(0.0, 1.0).alias("in_range"), (F.col("ml_score") == F.col("again")).alias("same_when_reloaded"),
        higher.alias("matches_score_higher"))


@register("training_rows", """
    SELECT md5(concat_ws(' ', 'GET', '/doc/' || doc_id, '', text, '', '200')) AS text, toxic AS label, count(*) AS rows
    FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as JSON lines; labels are written as number, text or boolean in turn."""
    path = f"{checkpoint_dir(spark)}/training-{uuid.uuid4()}"
    rows = inputs.labelled_documents(spark, sf_dir)
    kind, toxic = F.col("doc_id") % 3, F.col("label")
    label = F.when(kind == 0, toxic.cast("string")).when(kind == 1, F.concat(F.lit('"'), toxic.cast("string"), F.lit('"'))).otherwise(
        F.when(toxic > 0, "true").otherwise("false"))
    fields = F.to_json(F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"),
                                F.col("text").alias("content"), F.lit(200).alias("status")))
    rows.select(F.concat(F.left(fields, F.length(fields) - 1), F.lit(',"label":'), label, F.lit("}")).alias("value")).write.text(path)
    read = training.read_training(spark, path)
    return read.groupBy(F.md5("text").alias("text"), "label").agg(F.count("*").alias("rows"))
