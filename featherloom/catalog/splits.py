"""Queries on splits, folds, batches, ordering and the split-ratio sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import CELLS, draw_sql, query, r6, table, vectors
from featherloom.functions import seeded
from featherloom.operators import order, splits
from featherloom.plans import side_by_side
from featherloom.plans.settings import SvmSettings

SPLIT_SEED, BATCH_SEED, FOLD_SEED, SHUFFLE_SEED = 43, 61, 67, 73


def u(row_id: str, seed: int, modulus: int = 1000) -> str:
    return draw_sql(row_id, "0", seed, modulus)


@query(f"SELECT vec_id AS id, CASE WHEN {u('vec_id', SPLIT_SEED)} < 0.8 THEN 0 ELSE 1 END AS piece FROM embeddings")
def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = splits.train_validation(vectors(spark, sf_dir), "id", 0.2, seeded.modular(SPLIT_SEED))
    return train.select("id", F.lit(0).alias("piece")).unionByName(valid.select("id", F.lit(1).alias("piece")))


@query(
    f"""
SELECT event_id AS id, CASE WHEN d < 0.3 THEN 0 WHEN d < 0.6 THEN 1 ELSE 2 END AS piece
FROM (SELECT event_id, {u('event_id', SPLIT_SEED)} AS d FROM events)"""
)
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return rows.withColumn("piece", splits.split_column("id", [0.3, 0.3, 0.4], seeded.modular(SPLIT_SEED)))


@query(f"SELECT vec_id AS id, CAST(floor({u('vec_id', BATCH_SEED)} * 8) AS INTEGER) AS batch FROM embeddings")
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id")
    return rows.withColumn("batch", splits.batch_column("id", 8, seeded.modular(BATCH_SEED)))


@query(
    " UNION ALL ".join(
        f"SELECT vec_id AS id, {e} AS epoch, CAST(floor({u('vec_id', BATCH_SEED + e)} * 8) AS INTEGER) AS batch FROM embeddings"
        for e in (0, 1)
    )
)
def mini_batch_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of two epochs: every row has a new one in each."""
    rows = vectors(spark, sf_dir).select("id")
    epochs = [
        rows.select("id", F.lit(e).alias("epoch"), splits.batch_column("id", 8, seeded.modular(BATCH_SEED + e)).alias("batch"))
        for e in (0, 1)
    ]
    return epochs[0].unionByName(epochs[1])


@query(
    f"""
WITH f AS (SELECT vec_id AS id, label, CAST(floor({u('vec_id', FOLD_SEED)} * 5) AS INTEGER) AS fold FROM embeddings),
k AS (SELECT unnest(range(5)) AS k)
SELECT CAST(k.k AS INTEGER) AS fold, count(*) FILTER (WHERE f.fold <> k.k) AS train_rows,
       count(*) FILTER (WHERE f.fold = k.k) AS valid_rows,
       CAST(sum(f.label) FILTER (WHERE f.fold = k.k) AS BIGINT) AS valid_labels
FROM f, k GROUP BY k.k"""
)
def k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the training and validation part of every fold; a fold trains on what the others validate."""
    rows = vectors(spark, sf_dir).select(splits.fold_column("id", 5, seeded.modular(FOLD_SEED)).alias("fold"), "label")
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("valid_rows"), F.sum("label").alias("valid_labels"))
    whole = sizes.select(F.sum("valid_rows")).scalar()
    return sizes.select("fold", (whole - F.col("valid_rows")).alias("train_rows"), "valid_rows", "valid_labels")


@query(
    f"""
SELECT event_id, {u('event_id', SHUFFLE_SEED, 999983)} AS shuffle_key FROM events"""
)
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id")
    return order.shuffled(rows, "event_id", seeded.modular(SHUFFLE_SEED, 999983))


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 10")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.first_rows(vectors(spark, sf_dir).select("id", "label"), ["id"], 10)


@query(
    """
SELECT vec_id AS id, CAST(label AS DOUBLE) AS actual, round(CAST(embedding[1] AS DOUBLE) * 10, 6) + 0.0 AS predicted,
       round(CAST(embedding[1] AS DOUBLE) * 10 - label, 6) + 0.0 AS difference
FROM embeddings ORDER BY vec_id LIMIT 200"""
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(
        "id", F.col("label").cast("double").alias("label"), (F.col("features")[0] * 10).alias("predicted")
    )
    shown = order.preview(rows, "id", "label", "predicted")
    return shown.select("id", "actual", r6("predicted").alias("predicted"), r6("difference").alias("difference"))


SWEEP_STEPS = 12
SWEEP = SvmSettings(iterations=SWEEP_STEPS, tolerance=0.0)
SHARES = [0.5, 0.6, 0.7, 0.8, 0.9]


def signed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors labelled 1 above label 4, else 0."""
    return vectors(spark, sf_dir).select("id", (F.col("label") > 4).cast("double").alias("label"), "features")


def _sweep_draws() -> list[seeded.Draw]:
    return [seeded.modular(9 * k + 43) for k in range(len(SHARES))]


def _sweep_sql(margins: bool = False) -> str:
    """For every share a hinge SVM of some steps from zero (step 1, reg 0.01) and its error (or margins) on the other rows."""
    text = f"""
WITH {CELLS}, marked AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END AS s FROM embeddings
)"""
    branches = []
    for k, share in enumerate(SHARES):
        drawn = u("id", 9 * k + 43)
        text += f""",
r{k} AS MATERIALIZED (SELECT id, s FROM marked WHERE {drawn} < {share}),
w{k}_0 AS (SELECT DISTINCT pos, CAST(0 AS DOUBLE) AS w FROM cells)"""
        for t in range(1, SWEEP_STEPS + 1):
            text += f""",
m{k}_{t} AS MATERIALIZED (
  SELECT c.id, any_value(r.s) AS s, sum(c.x * w.w) AS m
  FROM cells c JOIN r{k} r ON r.id = c.id JOIN w{k}_{t - 1} w ON w.pos = c.pos GROUP BY c.id
),
g{k}_{t} AS MATERIALIZED (
  SELECT c.pos, sum(CASE WHEN m.s * m.m < 1 THEN -m.s ELSE 0 END * c.x) / (SELECT count(*) FROM m{k}_{t}) AS g
  FROM cells c JOIN m{k}_{t} m ON m.id = c.id GROUP BY c.pos
),
w{k}_{t} AS MATERIALIZED (
  SELECT w.pos, w.w * (1 - 0.01 / sqrt({t})) - g.g / sqrt({t}) AS w FROM w{k}_{t - 1} w JOIN g{k}_{t} g ON g.pos = w.pos
)"""
        told = "id, round(margin, 6) + 0.0 AS margin"
        if not margins:
            told = "count(*) AS rows, round(avg(CAST((s > 0) <> (margin > 0) AS INTEGER)), 6) + 0.0 AS error_rate"
        branches.append(
            f"""
SELECT CAST({share} AS DOUBLE) AS train_share, {told}
FROM (SELECT c.id, any_value(m.s) AS s, sum(c.x * w.w) AS margin
      FROM cells c JOIN marked m ON m.id = c.id JOIN w{k}_{SWEEP_STEPS} w ON w.pos = c.pos GROUP BY c.id)
WHERE {drawn} >= {share}"""
        )
    return text + " UNION ALL ".join(branches)


@query(_sweep_sql())
def ratio_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split shares 0.5 to 0.9; an SVM is trained on each training part and measured on the rest."""
    scored = side_by_side.sweep(signed_rows(spark, sf_dir), SHARES, _sweep_draws(), SWEEP)
    wrong = ((F.col("margin") > 0).cast("double") != F.col("label")).cast("double")
    found = scored.groupBy("train_share").agg(F.count(F.lit(1)).alias("rows"), F.avg(wrong).alias("error_rate"))
    return found.select("train_share", "rows", r6("error_rate").alias("error_rate"))


@query(_sweep_sql(margins=True))
def ratio_sweep_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of every row that a share's model has not seen."""
    scored = side_by_side.sweep(signed_rows(spark, sf_dir), SHARES, _sweep_draws(), SWEEP)
    return scored.select("train_share", "id", r6("margin").alias("margin"))


FOLDS, FOLD_STEPS = 5, 8


def _folds_sql(final: str) -> str:
    """A hinge SVM of a few steps for each fold, on the rows of the other folds; ``scored`` holds the fold's own rows."""
    text = f"""
WITH {CELLS}, marked AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END AS s, CAST(floor({u('vec_id', FOLD_SEED)} * {FOLDS}) AS INTEGER) AS fold
  FROM embeddings
), models AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS k),
sizes AS (SELECT k, count(*) AS n FROM models JOIN marked ON fold <> k GROUP BY k),
w0 AS (SELECT k, pos, CAST(0 AS DOUBLE) AS w FROM models, (SELECT DISTINCT pos FROM cells))"""
    for t in range(1, FOLD_STEPS + 1):
        text += f""",
m{t} AS MATERIALIZED (
  SELECT w.k, c.id, sum(c.x * w.w) AS m FROM cells c JOIN w{t - 1} w ON w.pos = c.pos GROUP BY w.k, c.id
), g{t} AS (
  SELECT m.k, c.pos, sum(CASE WHEN r.s * m.m < 1 THEN -r.s ELSE 0 END * c.x) / any_value(z.n) AS g
  FROM m{t} m JOIN marked r ON r.id = m.id AND r.fold <> m.k JOIN cells c ON c.id = m.id JOIN sizes z ON z.k = m.k GROUP BY m.k, c.pos
), w{t} AS MATERIALIZED (
  SELECT w.k, w.pos, w.w * (1 - 0.01 / sqrt({t})) - g.g / sqrt({t}) AS w FROM w{t - 1} w JOIN g{t} g ON g.k = w.k AND g.pos = w.pos
)"""
    return text + f""", scored AS (
  SELECT r.id, r.fold, any_value(r.s) AS s, sum(c.x * w.w) AS margin
  FROM marked r JOIN cells c ON c.id = r.id JOIN w{FOLD_STEPS} w ON w.k = r.fold AND w.pos = c.pos GROUP BY r.id, r.fold
)
{final}"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = SvmSettings(iterations=FOLD_STEPS, tolerance=0.0)
    return side_by_side.cross_validate(signed_rows(spark, sf_dir), FOLDS, seeded.modular(FOLD_SEED), settings)


@query(_folds_sql("SELECT id, fold, round(margin, 6) + 0.0 AS margin FROM scored"))
def cross_validated_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of every row under the model of its fold, which has learned from the other folds."""
    return _validated(spark, sf_dir).select("id", "fold", r6("margin").alias("margin"))


@query(
    _folds_sql(
        "SELECT fold, count(*) AS rows, round(avg(CAST((s > 0) <> (margin > 0) AS INTEGER)), 6) + 0.0 AS error_rate FROM scored GROUP BY fold"
    )
)
def cross_validated_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = side_by_side.fold_errors(_validated(spark, sf_dir))
    return found.select("fold", "rows", r6("error_rate").alias("error_rate"))
