"""Queries on linear classifiers: SVM, other classifiers, error rate, ROC."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import CELLS, SOFTMAXED, TERMS, draw_sql, query, r6, table, vectors
from featherloom.functions import seeded
from featherloom.operators import documents, metrics, scaling, splits
from featherloom.plans import classifiers, experiments, sparse_ae, svm
from featherloom.plans.settings import SparseAutoencoderSettings, SvmSettings
from featherloom.session import seal

FIXED = np.array([((k * 31) % 101 - 50) / 500.0 for k in range(64)])


def binary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("double"))


def labelled_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of the labelled documents; documents are chosen before they are split into words."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return seal(documents.term_triples(table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi")), "terms")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("label"))


MARGINS = f"""
WITH {CELLS}, margins AS (
  SELECT id, any_value(CASE WHEN label > 4 THEN 1.0 ELSE 0.0 END) AS label,
         sum(x * ((pos * 31) % 101 - 50) / CAST(500 AS DOUBLE)) + CAST(0.05 AS DOUBLE) AS margin
  FROM cells GROUP BY id
)"""


@query(
    MARGINS
    + """SELECT id, round(margin, 6) + 0.0 AS margin, CAST(CASE WHEN margin > 0 THEN 1 ELSE 0 END AS DOUBLE) AS predicted,
  CAST(CASE WHEN margin > 0.1 THEN 1 ELSE 0 END AS DOUBLE) AS strict FROM margins"""
)
def svm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw margin, default threshold and a higher one."""
    model = svm.SvmModel(FIXED, 0.05)
    scored = model.predict(binary_vectors(spark, sf_dir))
    strict = model.set_threshold(0.1).margin()
    raw = model.clear_threshold()
    return scored.select(
        "id",
        r6(svm.classify(raw.margin(), raw.threshold)).alias("margin"),
        "predicted",
        svm.classify(strict, 0.1).alias("strict"),
    )


@query(
    MARGINS
    + """SELECT round(avg(CAST(label <> CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END AS INTEGER)), 6) + 0.0 AS error_rate,
  round(1 - avg(CAST(label <> CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END AS INTEGER)), 6) + 0.0 AS accuracy,
  count(*) AS rows FROM margins"""
)
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.error_rate(svm.SvmModel(FIXED, 0.05).predict(binary_vectors(spark, sf_dir)))
    return found.select(r6("error_rate").alias("error_rate"), r6("accuracy").alias("accuracy"), "rows")


@query(
    MARGINS
    + """, ranked AS (
  SELECT label, rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2.0 AS r FROM margins
)
SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)), 6) + 0.0 AS auc
FROM ranked"""
)
def area_under_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = svm.SvmModel(FIXED, 0.05).clear_threshold()
    scored = binary_vectors(spark, sf_dir).select("label", model.margin().alias("score"))
    value = metrics.area_under_roc(scored)
    return spark.range(1).select(r6(F.lit(value)).alias("auc"))


def _unrolled(steps: int) -> str:
    """Sub-queries for ``steps`` hinge steps over word counts of labelled documents, step 1, reg 0.01."""
    text = f"""
WITH {TERMS}, labelled AS (SELECT doc_id AS doc, 2.0 * quality - 1 AS s FROM labels),
kept AS MATERIALIZED (SELECT t.* FROM terms t JOIN labelled l ON t.doc = l.doc),
w0 AS MATERIALIZED (SELECT DISTINCT col, CAST(0 AS DOUBLE) AS w FROM kept)"""
    for t in range(1, steps + 1):
        text += f""",
m{t} AS MATERIALIZED (SELECT k.doc, sum(k.value * w.w) AS m FROM kept k JOIN w{t - 1} w ON k.col = w.col GROUP BY k.doc),
p{t} AS MATERIALIZED (SELECT m.doc, CASE WHEN l.s * m.m < 1 THEN -l.s ELSE 0 END AS pull FROM m{t} m JOIN labelled l ON l.doc = m.doc),
g{t} AS MATERIALIZED (SELECT k.col, sum(p.pull * k.value) / (SELECT count(*) FROM p{t}) AS g FROM kept k JOIN p{t} p ON p.doc = k.doc GROUP BY k.col),
w{t} AS MATERIALIZED (SELECT w.col, w.w * (1 - 0.01 / sqrt({t})) - g.g / sqrt({t}) AS w FROM w{t - 1} w JOIN g{t} g ON g.col = w.col)"""
    return text + f"\nSELECT col, round(w, 6) + 0.0 AS w FROM w{steps}"


@query(_unrolled(3))
def svm_train_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three full-batch steps from zero over the word counts."""
    settings = SvmSettings(iterations=3, tolerance=0.0)
    weights = svm.train_sparse(labelled_terms(spark, sf_dir), quality(spark, sf_dir), settings)
    return weights.select("col", r6("w").alias("w"))


SAMPLE_SEED = 83


def _sampled(steps: int, fraction: float) -> str:
    """As above, each step over the documents whose draw lies in its window."""
    u = draw_sql("doc", "0", SAMPLE_SEED)
    text = f"""
WITH {TERMS}, labelled AS (SELECT doc, s, {u} AS u FROM (SELECT doc_id AS doc, 2.0 * quality - 1 AS s FROM labels)),
kept AS MATERIALIZED (SELECT t.*, l.s, l.u FROM terms t JOIN labelled l ON t.doc = l.doc),
w0 AS MATERIALIZED (SELECT DISTINCT col, CAST(0 AS DOUBLE) AS w FROM kept)"""
    for t in range(1, steps + 1):
        low, high = svm.window_bounds(t, fraction)
        inside = f"u >= {low!r} AND u < {high!r}" if high <= 1.0 else f"(u >= {low!r} OR u < {high - 1.0!r})"
        text += f""",
m{t} AS MATERIALIZED (
  SELECT k.doc, any_value(k.s) AS s, sum(k.value * w.w) AS m FROM kept k JOIN w{t - 1} w ON k.col = w.col WHERE {inside} GROUP BY k.doc
),
g{t} AS MATERIALIZED (
  SELECT k.col, sum(CASE WHEN m.s * m.m < 1 THEN -m.s ELSE 0 END * k.value) / (SELECT count(*) FROM m{t}) AS g
  FROM kept k JOIN m{t} m ON m.doc = k.doc GROUP BY k.col
),
w{t} AS MATERIALIZED (
  SELECT w.col, w.w * (1 - 0.01 / sqrt({t})) - coalesce(g.g, 0) / sqrt({t}) AS w FROM w{t - 1} w LEFT JOIN g{t} g ON g.col = w.col
)"""
    return text + f"\nSELECT col, round(w, 6) + 0.0 AS w FROM w{steps}"


@query(_sampled(5, 0.3))
def svm_train_words_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps over three tenths of the documents each; the fourth window goes on from the beginning."""
    settings = SvmSettings(iterations=5, fraction=0.3, tolerance=0.0)
    weights = svm.train_sparse(labelled_terms(spark, sf_dir), quality(spark, sf_dir), settings, seeded.modular(SAMPLE_SEED))
    return weights.select("col", r6("w").alias("w"))


@query(_unrolled(1))
def svm_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality(spark, sf_dir)
    kept = labelled_terms(spark, sf_dir)
    moved, _ = svm.sparse_step(sparse_ae.Spread.of(kept), labels, seal(svm.zero_weights(kept), "weights"), 1.0, 0.01)
    return moved.select("col", r6("w").alias("w"))


def _dense_unrolled(steps: int) -> str:
    text = f"""
WITH {CELLS}, signs AS (SELECT vec_id AS id, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END AS s FROM embeddings),
w0 AS (SELECT DISTINCT pos, CAST(0 AS DOUBLE) AS w FROM cells)"""
    for t in range(1, steps + 1):
        text += f""",
m{t} AS (SELECT c.id, sum(c.x * w.w) AS m FROM cells c JOIN w{t - 1} w ON w.pos = c.pos GROUP BY c.id),
p{t} AS (SELECT m.id, CASE WHEN s.s * m.m < 1 THEN -s.s ELSE 0 END AS pull FROM m{t} m JOIN signs s ON s.id = m.id),
g{t} AS (SELECT c.pos, sum(p.pull * c.x) / (SELECT count(*) FROM p{t}) AS g FROM cells c JOIN p{t} p ON p.id = c.id GROUP BY c.pos),
w{t} AS (SELECT w.pos, w.w * (1 - 0.01 / sqrt({t})) - g.g / sqrt({t}) AS w FROM w{t - 1} w JOIN g{t} g ON g.pos = w.pos)"""
    return text + f"\nSELECT pos, round(w, 6) + 0.0 AS w FROM w{steps}"


@query(_dense_unrolled(3))
def svm_train_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three full-batch steps from zero over dense vectors."""
    model = svm.train(binary_vectors(spark, sf_dir), SvmSettings(iterations=3, tolerance=0.0))
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    cells = spark.range(1).select(F.posexplode(weights).alias("pos", "w"))
    return cells.select(F.col("pos").cast("bigint").alias("pos"), r6("w").alias("w"))


@query(
    f"""
WITH {SOFTMAXED}, scored AS (
  SELECT s.doc, any_value(l.quality) AS label,
         sum(s.value * (((length(s.col) * 31 + ascii(s.col)) * 17 % 101 - 40) / CAST(500 AS DOUBLE))) AS margin
  FROM soft s JOIN labels l ON l.doc_id = s.doc GROUP BY s.doc
)
SELECT round(avg(CAST(label <> CASE WHEN margin > 0 THEN 1 ELSE 0 END AS INTEGER)), 6) + 0.0 AS error_rate,
       round(1 - avg(CAST(label <> CASE WHEN margin > 0 THEN 1 ELSE 0 END AS INTEGER)), 6) + 0.0 AS accuracy,
       count(*) AS rows
FROM scored"""
)
def words_score_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents -> word counts -> softmax -> labels -> fixed linear score -> accuracy."""
    labels = quality(spark, sf_dir)
    kept = labelled_terms(spark, sf_dir)
    triples = seal(scaling.document_softmax(kept, stable=True), "words")
    key = F.length("col") * 31 + F.ascii("col")
    weights = seal(triples.select("col").distinct().select("col", ((key * 17 % 101 - 40) / 500.0).alias("w")), "weights")
    found = metrics.error_rate(svm.predict_sparse(triples, weights).join(labels, "doc"))
    return found.select(r6("error_rate").alias("error_rate"), r6("accuracy").alias("accuracy"), "rows")


WORD_STEPS, WORD_SEED = 4, 43


def _accuracy_sql(words: str, source: str, final: str | None = None) -> str:
    """Hinge steps (step 1, reg 0.01) on nine tenths of the labelled documents, errors (or ``final``) on the rest."""
    drawn = draw_sql("doc_id", "0", WORD_SEED)
    text = f"""
WITH {words}, labelled AS MATERIALIZED (SELECT doc_id AS doc, quality, 2.0 * quality - 1 AS s, {drawn} < 0.9 AS train FROM labels),
kept AS MATERIALIZED (SELECT t.*, l.s FROM {source} t JOIN labelled l ON t.doc = l.doc AND l.train),
w0 AS MATERIALIZED (SELECT DISTINCT col, CAST(0 AS DOUBLE) AS w FROM kept)"""
    for t in range(1, WORD_STEPS + 1):
        text += f""",
p{t} AS MATERIALIZED (
  SELECT k.doc, CASE WHEN any_value(k.s) * sum(k.value * w.w) < 1 THEN -any_value(k.s) ELSE 0 END AS pull
  FROM kept k JOIN w{t - 1} w ON k.col = w.col GROUP BY k.doc
),
g{t} AS MATERIALIZED (
  SELECT k.col, sum(p.pull * k.value) / (SELECT count(*) FROM p{t}) AS g FROM kept k JOIN p{t} p ON p.doc = k.doc GROUP BY k.col
),
w{t} AS MATERIALIZED (
  SELECT w.col, w.w * (1 - 0.01 / sqrt({t})) - g.g / sqrt({t}) AS w FROM w{t - 1} w JOIN g{t} g ON g.col = w.col
)"""
    return (
        text
        + f""", scored AS (
  SELECT l.doc, any_value(l.quality) AS label, coalesce(sum(t.value * w.w), 0) AS margin
  FROM labelled l LEFT JOIN {source} t ON t.doc = l.doc LEFT JOIN w{WORD_STEPS} w ON w.col = t.col
  WHERE NOT l.train GROUP BY l.doc
)
"""
        + (final or """SELECT round(avg(CAST((label = 1) <> (margin > 0) AS INTEGER)), 6) + 0.0 AS error_rate,
       round(1 - avg(CAST((label = 1) <> (margin > 0) AS INTEGER)), 6) + 0.0 AS accuracy, count(*) AS rows FROM scored""")
    )


def _words_accuracy(spark: SparkSession, sf_dir: str, softmaxed: bool) -> DataFrame:
    found = experiments.words_accuracy(
        labelled_terms(spark, sf_dir),
        quality(spark, sf_dir),
        SvmSettings(iterations=WORD_STEPS, tolerance=0.0),
        softmaxed=softmaxed,
        draw=seeded.modular(WORD_SEED),
    )
    return found.select(r6("error_rate").alias("error_rate"), r6("accuracy").alias("accuracy"), "rows")


@query(_accuracy_sql(SOFTMAXED, "soft"))
def words_svm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words_accuracy(spark, sf_dir, True)


@query(_accuracy_sql(TERMS, "terms"))
def raw_words_svm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words_accuracy(spark, sf_dir, False)


def _words_margins(spark: SparkSession, sf_dir: str, softmaxed: bool) -> DataFrame:
    found = experiments.words_margins(
        labelled_terms(spark, sf_dir),
        quality(spark, sf_dir),
        SvmSettings(iterations=WORD_STEPS, tolerance=0.0),
        softmaxed=softmaxed,
        draw=seeded.modular(WORD_SEED),
    )
    return found.select("doc", r6("margin").alias("margin"))


MARGIN_OF_EACH = "SELECT doc, round(margin, 6) + 0.0 AS margin FROM scored"


@query(_accuracy_sql(SOFTMAXED, "soft", MARGIN_OF_EACH))
def words_svm_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of every held-out document under the model of softmaxed words."""
    return _words_margins(spark, sf_dir, True)


@query(_accuracy_sql(TERMS, "terms", MARGIN_OF_EACH))
def raw_words_svm_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of every held-out document under the model of raw counts."""
    return _words_margins(spark, sf_dir, False)


@query()
def encoded_svm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = SparseAutoencoderSettings(hidden=8, learning_rate=0.1, iterations=2, decay_in=0.01, decay_out=0.01)
    return experiments.encoded_accuracy(
        labelled_terms(spark, sf_dir), quality(spark, sf_dir), encoder, SvmSettings(iterations=5)
    )


@query()
def other_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes, decision tree and logistic regression on one feature table."""
    scaled = scaling.column_minmax(vectors(spark, sf_dir), "features", "scaled")
    rows = scaled.select("id", "label", F.col("scaled").alias("features"))
    train, test = splits.random_split(rows, "id", [0.7, 0.3], seeded.hashed(43))
    out = None
    for name in classifiers.CLASSIFIERS:
        found = classifiers.fit_and_predict(name, train, test).withColumn("classifier", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
