"""Queries on feed-forward networks over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import CELLS, query, r6, vectors
from featherloom.operators import metrics
from featherloom.plans import blocks, feedforward, local_descent
from featherloom.plans.estimator import Autoencoder, AutoencoderModel
from featherloom.plans.settings import NetworkSettings
from featherloom.sources.models import weight_table

SIZES = (64, 4, 2)
SETTINGS = NetworkSettings(sizes=SIZES, output="sigm", learning_rate=0.5, momentum=0.0, l2=0.1)


def rational_weights(sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Weights both engines can compute: ((layer*7 + out*17 + in*31) % 101 - 50) / 500."""
    return [
        ((layer * 7 + np.arange(n_out)[:, None] * 17 + np.arange(n_in + 1)[None, :] * 31) % 101 - 50) / 500.0
        for layer, (n_in, n_out) in enumerate(zip(sizes, sizes[1:]))
    ]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs in [0, 1]: label / 10 and whether the label is odd."""
    label = F.array(F.col("label") / 10.0, (F.col("label") % 2).cast("double"))
    return vectors(spark, sf_dir).select("id", label.alias("label"), "features")


def _weight(layer: int, out: str, into: str) -> str:
    return f"((({layer * 7} + {out} * 17 + ({into}) * 31) % 101 - 50) / CAST(500 AS DOUBLE))"


FORWARD = f"""
WITH {CELLS}, hidden_units AS (SELECT unnest(range(4)) AS h), output_units AS (SELECT unnest(range(2)) AS o),
targets AS (
  SELECT vec_id AS id, o, CASE WHEN o = 0 THEN label / CAST(10 AS DOUBLE) ELSE CAST(label % 2 AS DOUBLE) END AS y
  FROM embeddings, output_units
), hidden AS (
  SELECT c.id, u.h, 1 / (1 + exp(-(sum(c.x * {_weight(0, 'u.h', 'c.pos + 1')}) + {_weight(0, 'u.h', '0')}))) AS a
  FROM cells c, hidden_units u GROUP BY c.id, u.h
), outputs AS (
  SELECT h.id, u.o, 1 / (1 + exp(-(sum(h.a * {_weight(1, 'u.o', 'h.h + 1')}) + {_weight(1, 'u.o', '0')}))) AS p
  FROM hidden h, output_units u GROUP BY h.id, u.o
), errors AS (SELECT t.id, t.o, t.y, p.p, t.y - p.p AS e FROM targets t JOIN outputs p ON t.id = p.id AND t.o = p.o)"""

BACKWARD = (
    FORWARD
    + f""", delta_out AS (SELECT id, o, -e * p * (1 - p) AS d FROM errors),
delta_hidden AS (
  SELECT h.id, h.h, sum(d.d * {_weight(1, 'd.o', 'h.h + 1')}) * any_value(h.a) * (1 - any_value(h.a)) AS d
  FROM hidden h JOIN delta_out d ON h.id = d.id GROUP BY h.id, h.h
), hidden_in AS (SELECT id, h + 1 AS slot, a FROM hidden UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings),
cells_in AS (SELECT id, pos + 1 AS slot, x FROM cells UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings),
gradients AS (
  SELECT 0 AS layer, d.h AS unit, c.slot, sum(d.d * c.x) / (SELECT count(*) FROM embeddings) AS g
  FROM delta_hidden d JOIN cells_in c ON d.id = c.id GROUP BY d.h, c.slot
  UNION ALL
  SELECT 1, d.o, h.slot, sum(d.d * h.a) / (SELECT count(*) FROM embeddings)
  FROM delta_out d JOIN hidden_in h ON d.id = h.id GROUP BY d.o, h.slot
)"""
)


@query(FORWARD + "SELECT id, o AS pos, round(p, 6) + 0.0 AS predicted FROM outputs")
def nn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = feedforward.score(training_rows(spark, sf_dir), rational_weights(SIZES), SETTINGS)
    cells = scored.select("id", F.posexplode("predicted").alias("pos", "p"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), r6("p").alias("predicted"))


@query(
    FORWARD
    + "SELECT id, o AS pos, round(y, 6) + 0.0 AS label, round(p, 6) + 0.0 AS predicted, round(e, 6) + 0.0 AS error FROM errors"
)
def nn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedforward.predict(training_rows(spark, sf_dir), rational_weights(SIZES), SETTINGS)
    cells = found.select("id", F.posexplode(F.arrays_zip("label", "predicted", "error")).alias("pos", "c"))
    names = ["label", "predicted", "error"]
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), *[r6(f"c.{n}").alias(n) for n in names])


@query(
    FORWARD + "SELECT round(sum(e * e) / (SELECT count(*) FROM embeddings) * 0.5, 6) + 0.0 AS loss FROM errors"
)
def nn_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedforward.loss(training_rows(spark, sf_dir), rational_weights(SIZES), SETTINGS)
    return found.select(r6("loss").alias("loss"))


@query(
    FORWARD
    + "SELECT h AS pos, round(avg(a), 6) + 0.0 AS mean, round(0.01 * avg(a) + 0.09 * 0.2, 6) + 0.0 AS running FROM hidden GROUP BY h"
)
def nn_activation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean activation per unit, and the running average from an old value of 0.2."""
    means = feedforward.activation_means(training_rows(spark, sf_dir), rational_weights(SIZES), SETTINGS)
    cells = means.select(F.posexplode("mean").alias("pos", "m"))
    return cells.select(
        F.col("pos").cast("bigint").alias("pos"), r6("m").alias("mean"), r6(metrics.running_mean(F.col("m"), F.lit(0.2))).alias("running")
    )


@query(
    BACKWARD
    + "SELECT layer, unit, slot, round(g, 6) + 0.0 AS gradient FROM gradients"
)
def nn_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedforward.gradient_table(training_rows(spark, sf_dir), rational_weights(SIZES), SETTINGS)
    return _wide_keys(found).withColumn("gradient", r6("gradient"))


def _wide_keys(found: DataFrame) -> DataFrame:
    return found.withColumns({"unit": F.col("unit").cast("bigint"), "slot": F.col("slot").cast("bigint")})


def _old(layer: str) -> str:
    return f"((({layer} * 7 + unit * 17 + slot * 31) % 101 - 50) / CAST(500 AS DOUBLE))"


@query(
    BACKWARD
    + f"""SELECT layer, unit, slot,
  round({_old('layer')} - 0.5 * (g + CASE WHEN slot = 0 THEN 0 ELSE 0.1 * {_old('layer')} END), 6) + 0.0 AS w
FROM gradients"""
)
def nn_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after one step with an L2 penalty."""
    weights = rational_weights(SIZES)
    sums = blocks.collect_sums(feedforward.step_sums(training_rows(spark, sf_dir), weights, SETTINGS))
    gradients = [sums[f"w{k}"] / sums["loss"][0][1] for k in range(len(weights))]
    rate = SETTINGS.learning_rate
    moved, _ = feedforward.apply_gradients(weights, feedforward.zero_like(weights), gradients, rate, SETTINGS)
    cells = weight_table(spark, moved).select("layer", "unit", F.posexplode("w").alias("slot", "w"))
    return _wide_keys(cells).select("layer", "unit", "slot", r6("w").alias("w"))


def _history(spark: SparkSession, model: feedforward.TrainedNetwork, scored: DataFrame) -> DataFrame:
    """Predictions with the model's last training loss."""
    last = model.train_losses[-1] if model.train_losses else None
    cells = scored.select("id", F.posexplode("predicted").alias("pos", "predicted"))
    return cells.withColumn("train_loss", F.lit(last))


def _unrolled(steps: int, rate: float, momentum: float) -> str:
    """Full-batch training from the rational weights, step by step."""
    text = f"""
WITH {CELLS}, inputs AS (SELECT id, pos + 1 AS slot, x FROM cells UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings),
targets AS (
  SELECT vec_id AS id, o.unit, CASE WHEN o.unit = 0 THEN label / CAST(10 AS DOUBLE) ELSE CAST(label % 2 AS DOUBLE) END AS y
  FROM embeddings, (SELECT unnest(range(2)) AS unit) o
),
w0 AS (
  SELECT layer, unit, slot, ((layer * 7 + unit * 17 + slot * 31) % 101 - 50) / CAST(500 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS v
  FROM (SELECT 0 AS layer, unnest(range(4)) AS unit), (SELECT unnest(range(65)) AS slot)
  UNION ALL
  SELECT layer, unit, slot, ((layer * 7 + unit * 17 + slot * 31) % 101 - 50) / CAST(500 AS DOUBLE), CAST(0 AS DOUBLE)
  FROM (SELECT 1 AS layer, unnest(range(2)) AS unit), (SELECT unnest(range(5)) AS slot)
)"""
    for t in range(1, steps + 1):
        old = f"w{t - 1}"
        text += f""",
h{t} AS (
  SELECT i.id, w.unit + 1 AS slot, 1 / (1 + exp(-sum(i.x * w.w))) AS a
  FROM inputs i JOIN {old} w ON w.layer = 0 AND w.slot = i.slot GROUP BY i.id, w.unit
  UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings
),
p{t} AS (
  SELECT h.id, w.unit, 1 / (1 + exp(-sum(h.a * w.w))) AS p
  FROM h{t} h JOIN {old} w ON w.layer = 1 AND w.slot = h.slot GROUP BY h.id, w.unit
),
d{t} AS (
  SELECT p.id, p.unit, -(t.y - p.p) * p.p * (1 - p.p) AS d FROM p{t} p JOIN targets t ON t.id = p.id AND t.unit = p.unit
),
e{t} AS (
  SELECT h.id, h.slot - 1 AS unit, sum(d.d * w.w) * any_value(h.a * (1 - h.a)) AS d
  FROM h{t} h JOIN {old} w ON w.layer = 1 AND w.slot = h.slot JOIN d{t} d ON d.id = h.id AND d.unit = w.unit
  WHERE h.slot > 0 GROUP BY h.id, h.slot
),
g{t} AS (
  SELECT 0 AS layer, e.unit, i.slot, avg(e.d * i.x) AS g FROM e{t} e JOIN inputs i ON i.id = e.id GROUP BY e.unit, i.slot
  UNION ALL SELECT 1, d.unit, h.slot, avg(d.d * h.a) FROM d{t} d JOIN h{t} h ON h.id = d.id GROUP BY d.unit, h.slot
),
w{t} AS (
  SELECT layer, unit, slot, w - m AS w, m AS v FROM (
    SELECT o.layer, o.unit, o.slot, o.w,
           {rate} * (g.g + CASE WHEN o.slot = 0 THEN 0 ELSE 0.1 * o.w END) + {momentum} * o.v AS m
    FROM {old} o JOIN g{t} g ON g.layer = o.layer AND g.unit = o.unit AND g.slot = o.slot
  )
)"""
    return text + f"\nSELECT layer, unit, slot, round(w, 6) + 0.0 AS w FROM w{steps}"


@query(_unrolled(3, 0.5, 0.5))
def nn_train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after three epochs of one batch each, with momentum and L2, from fixed weights."""
    rows = training_rows(spark, sf_dir)
    settings = SETTINGS.with_(momentum=0.5)
    model = feedforward.train(rows, settings, rows.count(), epochs=3, init_weights=rational_weights(SIZES))
    cells = weight_table(spark, model.weights).select("layer", "unit", F.posexplode("w").alias("slot", "w"))
    return _wide_keys(cells).withColumn("w", r6("w"))


@query()
def nn_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    settings = SETTINGS.with_(learning_rate=0.5, momentum=0.5, rate_scaling=0.9)
    batch_size = max(1, rows.count() // 4)
    model = feedforward.train(rows, settings, batch_size, epochs=2, validation=0.2)
    return _history(spark, model, model.score(rows))


@query()
def nn_train_sparse_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float32, input mask, dropout and sparsity penalty together."""
    rows = training_rows(spark, sf_dir)
    settings = SETTINGS.with_(
        sparsity_penalty=0.01, input_mask=0.2, dropout=0.25, activation="tanh_opt", dtype="float32"
    )
    batch_size = max(1, rows.count() // 3)
    model = feedforward.train(rows, settings, batch_size, epochs=1)
    return _history(spark, model, model.score(rows))


@query()
def autoencoder_lbfgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder of the L-BFGS estimator on columns scaled to [0, 1]."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from featherloom.operators import scaling

    scaled = scaling.column_minmax(vectors(spark, sf_dir), "features", "scaled")
    rows = scaled.select("id", array_to_vector("scaled").alias("x"))
    model = Autoencoder(layers=[64, 4, 64], inputCol="x", outputCol="code", maxIter=5).fit(rows)
    return model.transform(rows).select("id", F.posexplode(vector_to_array("code")).alias("pos", "value"))


@query(FORWARD + "SELECT id, h AS pos, round(a, 6) + 0.0 AS value FROM hidden")
def autoencoder_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code column of the estimator's model with fixed weights."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors(spark, sf_dir).select("id", array_to_vector("features").alias("x"))
    model = AutoencoderModel([64, 4], rational_weights((64, 4)), inputCol="x", outputCol="code")
    cells = model.transform(rows).select("id", F.posexplode(vector_to_array("code")).alias("pos", "value"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


def _local_sql(rounds: int, rate: float, momentum: float, dealt: int = 8, batch: int = 4) -> str:
    """Rounds of ``dealt // batch`` updates in each replica, from the rational weights."""
    updates = dealt // batch
    text = f"""
WITH {CELLS}, dealt AS MATERIALIZED (
  SELECT vec_id AS id, label, vec_id // {dealt} AS rep, (row_number() OVER (PARTITION BY vec_id // {dealt} ORDER BY vec_id) - 1) // {batch} AS place
  FROM embeddings
), sizes AS (SELECT rep, count(*) AS n FROM dealt GROUP BY rep),
inputs AS MATERIALIZED (
  SELECT d.rep, d.place, d.id, c.pos + 1 AS slot, c.x FROM dealt d JOIN cells c USING (id) UNION ALL SELECT rep, place, id, 0, 1.0 FROM dealt
), targets AS MATERIALIZED (
  SELECT id, unit, CASE WHEN unit = 0 THEN label / CAST(10 AS DOUBLE) ELSE CAST(label % 2 AS DOUBLE) END AS y
  FROM dealt, (SELECT unnest(range(2)) AS unit)
), t0 AS (
  SELECT layer, unit, slot, {_old('layer')} AS w FROM (
    SELECT 0 AS layer, unit, slot FROM (SELECT unnest(range(4)) AS unit), (SELECT unnest(range(65)) AS slot)
    UNION ALL SELECT 1, unit, slot FROM (SELECT unnest(range(2)) AS unit), (SELECT unnest(range(5)) AS slot))
)"""
    for r in range(1, rounds + 1):
        text += f""",
p{r}_0 AS MATERIALIZED (SELECT rep, layer, unit, slot, w, CAST(0 AS DOUBLE) AS v FROM t{r - 1}, sizes)"""
        for s in range(1, updates + 1):
            own, k = f"p{r}_{s - 1}", f"{r}_{s}"
            text += f""",
i{k} AS MATERIALIZED (SELECT * FROM inputs WHERE place = {s - 1}),
h{k} AS MATERIALIZED (
  SELECT i.rep, i.id, w.unit + 1 AS slot, 1 / (1 + exp(-sum(i.x * w.w))) AS a
  FROM i{k} i JOIN {own} w ON w.rep = i.rep AND w.layer = 0 AND w.slot = i.slot GROUP BY i.rep, i.id, w.unit
  UNION ALL SELECT rep, id, 0, 1.0 FROM dealt WHERE place = {s - 1}
), d{k} AS MATERIALIZED (
  SELECT p.rep, p.id, p.unit, -(t.y - p.p) * p.p * (1 - p.p) AS d FROM (
    SELECT h.rep, h.id, w.unit, 1 / (1 + exp(-sum(h.a * w.w))) AS p
    FROM h{k} h JOIN {own} w ON w.rep = h.rep AND w.layer = 1 AND w.slot = h.slot GROUP BY h.rep, h.id, w.unit
  ) p JOIN targets t ON t.id = p.id AND t.unit = p.unit
), e{k} AS MATERIALIZED (
  SELECT h.rep, h.id, h.slot - 1 AS unit, sum(d.d * w.w) * any_value(h.a * (1 - h.a)) AS d
  FROM h{k} h JOIN {own} w ON w.rep = h.rep AND w.layer = 1 AND w.slot = h.slot JOIN d{k} d ON d.id = h.id AND d.unit = w.unit
  WHERE h.slot > 0 GROUP BY h.rep, h.id, h.slot
), g{k} AS MATERIALIZED (
  SELECT i.rep, 0 AS layer, e.unit, i.slot, avg(e.d * i.x) AS g FROM e{k} e JOIN i{k} i ON i.id = e.id GROUP BY i.rep, e.unit, i.slot
  UNION ALL SELECT h.rep, 1, d.unit, h.slot, avg(d.d * h.a) FROM d{k} d JOIN h{k} h ON h.id = d.id GROUP BY h.rep, d.unit, h.slot
), p{k} AS MATERIALIZED (
  SELECT rep, layer, unit, slot, w - m AS w, m AS v FROM (
    SELECT o.rep, o.layer, o.unit, o.slot, o.w,
           CASE WHEN g.g IS NULL THEN 0 ELSE {rate} * (g.g + CASE WHEN o.slot = 0 THEN 0 ELSE 0.1 * o.w END) + {momentum} * o.v END AS m
    FROM {own} o LEFT JOIN g{k} g ON g.rep = o.rep AND g.layer = o.layer AND g.unit = o.unit AND g.slot = o.slot
  )
)"""
        text += f""",
t{r} AS MATERIALIZED (SELECT layer, unit, slot, sum(w * n) / sum(n) AS w FROM p{r}_{updates} JOIN sizes USING (rep) GROUP BY layer, unit, slot)"""
    return text + f"\nSELECT layer, unit, slot, round(w, 6) + 0.0 AS w FROM t{rounds}"


@query(_local_sql(2, 0.5, 0.5))
def nn_train_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after two rounds of local descent, batches of four rows in replicas of eight, from fixed weights."""
    model = local_descent.train_network(
        training_rows(spark, sf_dir),
        SETTINGS.with_(momentum=0.5),
        batch_size=4,
        rounds=2,
        replica=F.floor(F.col("id") / 8),
        order=F.col("id"),
        init_weights=rational_weights(SIZES),
    )
    cells = weight_table(spark, model.weights).select("layer", "unit", F.posexplode("w").alias("slot", "w"))
    return _wide_keys(cells).withColumn("w", r6("w"))
