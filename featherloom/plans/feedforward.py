"""Feed-forward networks trained by distributed mini-batch gradients.

Rows are (id, label array, features array).  One step is one Spark job: every task
runs the forward and backward pass on its Arrow batches and returns summed
gradients, activation sums and the loss together.  Only model-sized state crosses
the driver, and its size is checked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions.activations import TANH_GAIN, TANH_SLOPE
from featherloom.functions.seeded import hashed
from featherloom.operators.metrics import half_mean_squared_error, mean_vector
from featherloom.operators.splits import batch_column, split_column
from featherloom.plans import blocks
from featherloom.plans.settings import NetworkSettings
from featherloom.session import check_state_size, release, seal
from featherloom.sources.models import load_model, save_model

Weights = list[np.ndarray]


def initial_weights(settings: NetworkSettings) -> Weights:
    """Uniform in +-4 sqrt(6 / (fan out + fan in)); bias is column 0."""
    rng = np.random.default_rng(settings.seed)
    sizes = settings.sizes
    check_state_size(sum(o * (i + 1) for i, o in zip(sizes, sizes[1:])), "the network")
    return [
        rng.uniform(-1.0, 1.0, (n_out, n_in + 1)) * 4.0 * np.sqrt(6.0 / (n_out + n_in))
        for n_in, n_out in zip(sizes, sizes[1:])
    ]


def zero_like(weights: Weights) -> Weights:
    return [np.zeros_like(w) for w in weights]


def _activate(z: np.ndarray, kind: str) -> np.ndarray:
    return blocks.sigmoid(z) if kind == "sigm" else TANH_GAIN * np.tanh(TANH_SLOPE * z)


def _slope(a: np.ndarray, kind: str) -> np.ndarray:
    """Derivative of the activation in terms of its output."""
    if kind == "sigm":
        return a * (1.0 - a)
    return TANH_GAIN * TANH_SLOPE * (1.0 - (a / TANH_GAIN) ** 2)


def _with_bias(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(a), 1), a.dtype), a], axis=1)


@dataclass
class _Pass:
    """Activations of one block of rows: inputs and hidden layers with bias, then the output."""

    inputs: list[np.ndarray]
    masks: list[np.ndarray | None]
    output: np.ndarray


def forward_block(
    x: np.ndarray, weights: Weights, settings: NetworkSettings, ids: np.ndarray | None = None, seed: int | None = None
) -> _Pass:
    """Forward pass; with ``seed`` dropout masks are drawn, without it units are scaled instead."""
    keep = 1.0 - settings.dropout
    inputs, masks = [_with_bias(x)], [None]
    for layer, w in enumerate(weights[:-1]):
        a = _activate(inputs[-1] @ w.T, settings.activation)
        mask = None
        if settings.dropout > 0:
            if seed is None:
                a = a * keep
            else:
                draws = blocks.cell_draws(ids, a.shape[1], seed * 1009 + layer + 1)
                mask = (draws > settings.dropout).astype(a.dtype)
                a = a * mask
        inputs.append(_with_bias(a))
        masks.append(mask)
    z = inputs[-1] @ weights[-1].T
    out = {"sigm": blocks.sigmoid, "softmax": blocks.softmax, "linear": lambda v: v}[settings.output](z)
    return _Pass(inputs, masks, out)


def gradient_block(
    state: _Pass, error: np.ndarray, weights: Weights, settings: NetworkSettings, mean_activation: list | None
) -> Weights:
    """Summed gradients of one block: dW of layer l is delta(l+1)' a(l)."""
    delta = -error * (state.output * (1.0 - state.output)) if settings.output == "sigm" else -error
    gradients: Weights = [delta.T @ state.inputs[-1]]
    for layer in range(len(weights) - 1, 0, -1):
        back = (delta @ weights[layer])[:, 1:]
        if mean_activation is not None:
            p, t = mean_activation[layer - 1], settings.sparsity_target
            back = back + settings.sparsity_penalty * (-t / p + (1.0 - t) / (1.0 - p))
        delta = back * _slope(state.inputs[layer][:, 1:], settings.activation)
        if state.masks[layer] is not None:
            delta = delta * state.masks[layer]
        gradients.insert(0, delta.T @ state.inputs[layer - 1])
    return gradients


def score(rows: DataFrame, weights: Weights, settings: NetworkSettings, activations: bool = False) -> DataFrame:
    """``rows`` plus ``predicted`` (and ``hidden``, the last hidden layer): a pure projection.

    Runs on batch and streaming DataFrames alike.
    """
    bound = rows.sparkSession.sparkContext.broadcast(_cast(weights, settings.dtype))
    added = [T.StructField("predicted", T.ArrayType(T.DoubleType()))]
    if activations:
        added.append(T.StructField("hidden", T.ArrayType(T.DoubleType())))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            state = forward_block(blocks.matrix(batch, "features", settings.dtype), bound.value, settings)
            new = {"predicted": state.output}
            if activations:
                new["hidden"] = state.inputs[-1][:, 1:]
            yield blocks.with_columns(batch, new)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + added))


def predict(rows: DataFrame, weights: Weights, settings: NetworkSettings) -> DataFrame:
    """label, features, predicted and error = label - predicted, in test mode."""
    scored = score(rows, weights, settings)
    return scored.withColumn("error", F.zip_with("label", "predicted", lambda y, p: y - p))


def loss(rows: DataFrame, weights: Weights, settings: NetworkSettings) -> DataFrame:
    """One row: half mean squared error in test mode."""
    return half_mean_squared_error(predict(rows, weights, settings))


def activation_means(rows: DataFrame, weights: Weights, settings: NetworkSettings) -> DataFrame:
    """One row: mean of the last hidden layer's units, without the bias slot."""
    return mean_vector(score(rows, weights, settings, activations=True), "hidden")


def step_sums(
    rows: DataFrame,
    weights: Weights,
    settings: NetworkSettings,
    seed: int = 0,
    mean_activation: list[np.ndarray] | None = None,
    gradients: bool = True,
    training: bool = True,
    block_size: int | None = None,
) -> DataFrame:
    """(name, unit, w) sums over ``rows``.

    ``w0``, ``w1``... are gradient sums per layer, ``a1``... activation sums per
    hidden layer, ``loss`` holds the squared error and the row count.
    """
    bound = rows.sparkSession.sparkContext.broadcast((_cast(weights, settings.dtype), mean_activation))

    def contribute(batch):
        w, p = bound.value
        ids = blocks.vector(batch, "id")
        x = blocks.matrix(batch, "features", settings.dtype)
        y = blocks.matrix(batch, "label", settings.dtype)
        if training and settings.input_mask > 0:
            x = x * (blocks.cell_draws(ids, x.shape[1], seed * 1009) >= settings.input_mask)
        state = forward_block(x, w, settings, ids, seed if training else None)
        error = y - state.output
        out = {"loss": np.array([float((error.astype(np.float64) ** 2).sum()), len(x)])}
        for layer in range(1, len(w)):
            out[f"a{layer}"] = state.inputs[layer][:, 1:].sum(axis=0, dtype=np.float64)
        if gradients:
            for layer, g in enumerate(gradient_block(state, error, w, settings, p)):
                out[f"w{layer}"] = g
        return out

    return blocks.sum_over_rows(rows.select("id", "label", "features"), contribute, block_size)


def gradient_table(rows: DataFrame, weights: Weights, settings: NetworkSettings, seed: int = 0) -> DataFrame:
    """(layer, unit, slot, gradient): mean gradient over ``rows`` as a table."""
    sums = step_sums(rows, weights, settings, seed)
    count = sums.where("name = 'loss'").select(F.element_at("w", 2)).scalar()
    return (
        sums.where(F.col("name").startswith("w"))
        .select(F.substring("name", 2, 9).cast("int").alias("layer"), "unit", F.posexplode("w").alias("slot", "g"))
        .select("layer", "unit", "slot", (F.col("g") / count).alias("gradient"))
    )


def apply_gradients(
    weights: Weights, velocity: Weights, gradients: Weights, rate: float, settings: NetworkSettings
) -> tuple[Weights, Weights]:
    """W -= V with V = rate * (gradient + l2 * weight) + momentum * V.

    The penalty skips the bias column.  ``l2_on_gradient`` scales the gradient
    instead of the weight.
    """
    new_w, new_v = [], []
    for w, v, g in zip(weights, velocity, gradients):
        penalty = (g if settings.l2_on_gradient else w).copy()
        penalty[:, 0] = 0.0
        move = rate * (g + settings.l2 * penalty)
        if settings.momentum > 0:
            move = move + settings.momentum * v
            v = move
        new_w.append(w - move)
        new_v.append(v)
    return new_w, new_v


def _cast(weights: Weights, dtype: str) -> Weights:
    return [w.astype(dtype) for w in weights]


@dataclass
class TrainedNetwork:
    settings: NetworkSettings
    weights: Weights
    batch_losses: list[float] = field(default_factory=list)
    train_losses: list[float] = field(default_factory=list)
    validation_losses: list[float] = field(default_factory=list)

    def predict(self, rows: DataFrame) -> DataFrame:
        return predict(rows, self.weights, self.settings)

    def score(self, rows: DataFrame) -> DataFrame:
        return score(rows, self.weights, self.settings)

    def loss(self, rows: DataFrame) -> DataFrame:
        return loss(rows, self.weights, self.settings)

    def save(self, spark: SparkSession, path: str) -> None:
        save_model(spark, path, "feedforward", self.weights, self.settings.__dict__)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedNetwork:
        weights, found = load_model(spark, path, "feedforward")
        found["sizes"] = tuple(found["sizes"])
        return cls(NetworkSettings(**found), weights)


def stage_rows(rows: DataFrame, validation: float, seed: int) -> DataFrame:
    """(id, label, features, held), written once; ``held`` rows are for validation."""
    held = F.when(split_column("id", [1.0 - validation, validation], hashed(seed)) == 1, True).otherwise(False)
    return seal(rows.select("id", "label", "features").withColumn("held", held), "rows")


def batch_numbers(n_batches: int, seed: int, epoch: int) -> Column:
    """Batch of each row in an epoch: a new draw every epoch."""
    return batch_column("id", n_batches, hashed(seed + 1 + 1_000_003 * epoch))


def stage_batches(staged: DataFrame, n_batches: int, seed: int, epoch: int) -> DataFrame:
    """The training rows of an epoch, written in the order of their batches.

    Files are ranges of (batch, row hash) of about equal size whatever the batches'
    sizes, and sorted, so a step reads the row groups of its own batch and the
    number of batches has no bound.
    """
    tasks = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = staged.where(~F.col("held")).select("id", "label", "features")
    rows = rows.withColumn("batch", batch_numbers(n_batches, seed, epoch))
    return seal(rows.repartitionByRange(tasks, "batch", F.xxhash64("id")).sortWithinPartitions("batch"), "batches")


def train(
    rows: DataFrame,
    settings: NetworkSettings,
    batch_size: int,
    epochs: int,
    validation: float = 0.0,
    init_weights: Weights | None = None,
) -> TrainedNetwork:
    """Mini-batch training; with fewer rows than ``batch_size`` no step is made.

    ``init_weights`` replaces the random weights per layer (None keeps a layer's).
    """
    weights = initial_weights(settings)
    for layer, given in enumerate(init_weights or []):
        if given is not None:
            if given.shape != weights[layer].shape:
                raise ValueError(f"layer {layer} needs shape {weights[layer].shape}, got {given.shape}")
            weights[layer] = given
    velocity = zero_like(weights)
    mean_activation = [np.zeros(n) for n in settings.sizes[1:-1]]
    staged = stage_rows(rows, validation, settings.seed)
    n_batches = staged.where(~F.col("held")).count() // batch_size
    model = TrainedNetwork(settings, weights)
    rate, step = settings.learning_rate, 0
    for epoch in range(epochs):
        table = stage_batches(staged, n_batches, settings.seed, epoch) if n_batches else None
        for batch in range(n_batches):
            step += 1
            part = table.where(F.col("batch") == batch)
            p = None
            if settings.sparsity_penalty > 0:
                sums = blocks.collect_sums(step_sums(part, weights, settings, step, gradients=False))
                if "loss" not in sums:
                    continue
                n = sums["loss"][0][1]
                mean_activation = [
                    settings.activation_gain * sums[f"a{k + 1}"][0] / n + settings.activation_decay * old
                    for k, old in enumerate(mean_activation)
                ]
                p = mean_activation
            sums = blocks.collect_sums(step_sums(part, weights, settings, step, p))
            if "loss" not in sums:
                continue
            squared, n = sums["loss"][0]
            gradients = [sums[f"w{k}"] / n for k in range(len(weights))]
            weights, velocity = apply_gradients(weights, velocity, gradients, rate, settings)
            model.batch_losses.append(float(0.5 * squared / n))
        if table is not None:
            release(table)
        losses = _epoch_losses(staged, weights, settings)
        model.train_losses.append(losses[0])
        model.validation_losses.append(losses[1] if validation > 0 else 0.0)
        rate *= settings.rate_scaling
    release(staged)
    model.weights = weights
    return model


def _epoch_losses(table: DataFrame, weights: Weights, settings: NetworkSettings) -> tuple[float, float]:
    """Training and validation loss in one pass."""
    scored = predict(table, weights, settings)
    found = {
        row["held"]: row["loss"]
        for row in scored.groupBy("held")
        .agg(
            (
                F.sum(F.aggregate("error", F.lit(0.0), lambda s, e: s + e * e)) / F.count(F.lit(1)) * 0.5
            ).alias("loss")
        )
        .collect()
    }
    return float(found.get(False, 0.0) or 0.0), float(found.get(True, 0.0) or 0.0)
