"""Queries on denoising autoencoders and softmax regression over 0/1 vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import CELLS, draw_sql, query, r6, vectors
from featherloom.functions import seeded
from featherloom.operators import masks
from featherloom.plans import blocks, denoise
from featherloom.plans.settings import DenoiseSettings

HIDDEN, SEED = 3, 29


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, features): 1 where the embedding is positive."""
    return vectors(spark, sf_dir).withColumn("features", F.transform("features", lambda x: (x > 0).cast("double")))


def fixed_layer() -> denoise.TiedLayer:
    h, v = np.arange(HIDDEN)[:, None], np.arange(64)[None, :]
    w = ((h * 17 + v * 31) % 101 - 50) / 500.0
    return denoise.TiedLayer(w, (np.arange(HIDDEN) - 1) / 10.0, (np.arange(64) % 7 - 3) / 20.0)


W = "((h * 17 + pos * 31) % 101 - 50) / CAST(500 AS DOUBLE)"
HB = "(h - 1) / CAST(10 AS DOUBLE)"
VB = "(pos % 7 - 3) / CAST(20 AS DOUBLE)"


def _stages(noisy: str) -> str:
    return f"""
WITH {CELLS}, units AS (SELECT unnest(range({HIDDEN})) AS h),
x AS (SELECT id, pos, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM cells),
t AS (SELECT id, pos, x, {noisy} AS n FROM x),
y AS (SELECT id, h, 1 / (1 + exp(-(sum(n * {W}) + any_value({HB})))) AS y FROM t, units GROUP BY id, h),
z AS (
  SELECT t.id, t.pos, any_value(t.x) AS x, any_value(t.n) AS n,
         1 / (1 + exp(-(sum(y.y * {W}) + any_value({VB})))) AS z
  FROM t JOIN y ON y.id = t.id GROUP BY t.id, t.pos
)"""


@query(_stages("x") + "SELECT id, pos, round(z, 6) + 0.0 AS value FROM z")
def dae_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denoise.reconstruct(bits(spark, sf_dir), fixed_layer())
    cells = found.select("id", F.posexplode("reconstructed").alias("pos", "value"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


@query(_stages("x") + "SELECT id, h AS pos, round(y, 6) + 0.0 AS value FROM y")
def dae_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denoise.reconstruct(bits(spark, sf_dir), fixed_layer())
    cells = found.select("id", F.posexplode("hidden").alias("pos", "value"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


NOISY = f"CASE WHEN x = 0 THEN 0.0 WHEN {draw_sql('id', 'pos', SEED)} < 0.7 THEN 1.0 ELSE 0.0 END::DOUBLE"


@query(
    _stages(NOISY)
    + f""", lh AS (
  SELECT z.id, y.h, sum((z.x - z.z) * {W}) * any_value(y.y) * (1 - any_value(y.y)) AS l
  FROM z JOIN y ON y.id = z.id GROUP BY z.id, y.h
), n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'w' AS name, y.h AS unit, z.pos AS slot, round(0.1 * sum(l.l * z.n + (z.x - z.z) * y.y) / any_value(n.n), 6) + 0.0 AS moved
FROM z JOIN y ON y.id = z.id JOIN lh l ON l.id = z.id AND l.h = y.h, n GROUP BY y.h, z.pos
UNION ALL SELECT 'hb', 0, h, round(0.1 * avg(l), 6) + 0.0 FROM lh GROUP BY h
UNION ALL SELECT 'vb', 0, pos, round(0.1 * avg(x - z), 6) + 0.0 FROM z GROUP BY pos"""
)
def dae_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of every parameter in one step on corrupted input."""
    rows = bits(spark, sf_dir)
    noisy = masks.binary_corruption("features", "id", 0.3, seeded.modular(SEED))
    found = denoise.step_table(rows.withColumn("features_tilde", noisy), fixed_layer(), 0.3, 0.1)
    return found.select(
        "name", F.col("unit").cast("bigint").alias("unit"), F.col("slot").cast("bigint").alias("slot"), r6("moved").alias("moved")
    )


def fixed_head() -> denoise.SoftmaxHead:
    c, p = np.arange(10)[:, None], np.arange(64)[None, :]
    return denoise.SoftmaxHead(((c * 17 + p * 31) % 101 - 50) / 500.0, ((np.arange(10) * 11) % 7 - 3) / 10.0)


HEAD_W = "((c * 17 + pos * 31) % 101 - 50) / CAST(500 AS DOUBLE)"
HEAD_B = "((c * 11) % 7 - 3) / CAST(10 AS DOUBLE)"
SCORED = f"""
WITH {CELLS}, x AS MATERIALIZED (SELECT id, pos, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM cells),
classes AS (SELECT unnest(range(10)) AS c),
raised AS MATERIALIZED (SELECT id, c, exp(sum(x * {HEAD_W}) + any_value({HEAD_B})) AS e FROM x, classes GROUP BY id, c),
p AS MATERIALIZED (SELECT id, c, e / sum(e) OVER (PARTITION BY id) AS p FROM raised),
gap AS MATERIALIZED (
  SELECT p.id, p.c, CASE WHEN m.label = p.c THEN 1.0 ELSE 0.0 END::DOUBLE - p.p AS g FROM p JOIN embeddings m ON m.vec_id = p.id
)"""


@query(
    SCORED
    + f""", n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'w' AS name, c AS unit, pos AS slot, round({HEAD_W} + 0.1 * s / n.n, 6) + 0.0 AS value
FROM (SELECT g.c, x.pos, sum(g.g * x.x) AS s FROM gap g JOIN x ON x.id = g.id GROUP BY g.c, x.pos), n
UNION ALL SELECT 'b', 0, c, round({HEAD_B} + 0.1 * s / n.n, 6) + 0.0 FROM (SELECT c, sum(g) AS s FROM gap GROUP BY c), n"""
)
def softmax_regression_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and biases after one step."""
    head = fixed_head()
    moved = denoise.moved_head(head, blocks.collect_sums(denoise.softmax_sums(one_hot(spark, sf_dir), head)), 0.1)
    rows = [("w", c, w.tolist()) for c, w in enumerate(moved.w)] + [("b", 0, moved.b.tolist())]
    cells = spark.createDataFrame(rows, "name string, unit long, w array<double>")
    cells = cells.select("name", "unit", F.posexplode("w").alias("slot", "value"))
    return cells.select("name", "unit", F.col("slot").cast("bigint").alias("slot"), r6("value").alias("value"))


@query(SCORED + "SELECT id, c AS pos, round(p, 6) + 0.0 AS value FROM p")
def softmax_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denoise.softmax_predict(bits(spark, sf_dir), fixed_head())
    cells = found.select("id", F.posexplode("probabilities").alias("pos", "value"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (F.col("label") == c).cast("double"))
    return bits(spark, sf_dir).select("id", classes.alias("label"), "features")


@query()
def dae_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bits(spark, sf_dir)
    layer, errors = denoise.train_layer(rows, DenoiseSettings(hidden=HIDDEN, epochs=3))
    found = denoise.reconstruct(rows, layer)
    return found.select("id", F.posexplode("hidden").alias("pos", "value")).withColumn("error", F.lit(errors[-1]))


@query()
def stacked_dae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two denoising layers and a softmax head over the ten labels."""
    rows = one_hot(spark, sf_dir)
    model = denoise.train_stack(rows, [8, 4], 10, DenoiseSettings(hidden=8, epochs=2), head_epochs=2)
    return model.predict(rows).select("id", F.posexplode("probabilities").alias("pos", "value"))
