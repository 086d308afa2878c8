"""Denoising autoencoders with tied weights, their stack, and a softmax head.

Rows are (id, features array of 0/1).  An epoch is one Spark job that adds up the
gradients of all rows; the update is rate * sum / rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.plans import blocks
from featherloom.plans.settings import DenoiseSettings
from featherloom.session import check_state_size, sealed
from featherloom.sources.models import load_model, save_model


@dataclass
class TiedLayer:
    """W is (hidden, visible); decoding uses its transpose."""

    w: np.ndarray
    hidden_bias: np.ndarray
    visible_bias: np.ndarray

    @classmethod
    def initial(cls, visible: int, hidden: int, seed: int) -> TiedLayer:
        check_state_size(visible * hidden, "the layer")
        w = np.random.default_rng(seed).uniform(-1.0 / visible, 1.0 / visible, (hidden, visible))
        return cls(w, np.zeros(hidden), np.zeros(visible))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return blocks.sigmoid(x @ self.w.T + self.hidden_bias)

    def decode(self, y: np.ndarray) -> np.ndarray:
        return blocks.sigmoid(y @ self.w + self.visible_bias)


def corrupted(x: np.ndarray, ids: np.ndarray, level: float, seed: int) -> np.ndarray:
    return x * (blocks.cell_draws(ids, x.shape[1], seed) < 1.0 - level)


def sampled_through(layers: list[TiedLayer], x: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Bernoulli sample of every layer's hidden units, from the bottom up."""
    for depth, layer in enumerate(layers):
        p = layer.encode(x)
        x = (blocks.cell_draws(ids, p.shape[1], seed * 31 + depth + 1) < p).astype(float)
    return x


def denoise_sums(
    rows: DataFrame, layer: TiedLayer, corruption: float, seed: int, below: list[TiedLayer] | None = None
) -> DataFrame:
    """(name, unit, w): summed updates ``w``, ``hb``, ``vb`` and (row count, squared error) ``n``.

    ``features_tilde``, when present, is used as the corrupted input.
    """
    bound = rows.sparkSession.sparkContext.broadcast((layer, below or []))
    given = "features_tilde" in rows.columns

    def contribute(batch):
        top, lower = bound.value
        ids = blocks.vector(batch, "id")
        x = sampled_through(lower, blocks.matrix(batch, "features"), ids, seed)
        noisy = blocks.matrix(batch, "features_tilde") if given else corrupted(x, ids, corruption, seed * 31)
        y = top.encode(noisy)
        visible = x - top.decode(y)
        hidden = (visible @ top.w.T) * y * (1.0 - y)
        return {
            "w": hidden.T @ noisy + y.T @ visible,
            "hb": hidden.sum(axis=0),
            "vb": visible.sum(axis=0),
            "n": np.array([len(x), (visible**2).sum()]),
        }

    columns = ["id", "features"] + (["features_tilde"] if given else [])
    return blocks.sum_over_rows(rows.select(*columns), contribute)


def moved_layer(layer: TiedLayer, sums: dict[str, np.ndarray], rate: float) -> TiedLayer:
    scale = rate / sums["n"][0][0]
    return TiedLayer(
        layer.w + scale * sums["w"],
        layer.hidden_bias + scale * sums["hb"][0],
        layer.visible_bias + scale * sums["vb"][0],
    )


def step_table(rows: DataFrame, layer: TiedLayer, corruption: float, rate: float, seed: int = 0) -> DataFrame:
    """(name, unit, slot, moved): the change each parameter makes in one step, as a table."""
    sums = denoise_sums(rows, layer, corruption, seed)
    count = sums.where("name = 'n'").select(F.element_at("w", 1)).scalar()
    return (
        sums.where("name <> 'n'")
        .select("name", "unit", F.posexplode("w").alias("slot", "g"))
        .select("name", "unit", "slot", (F.lit(rate) * F.col("g") / count).alias("moved"))
    )


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows to train on")
    return first[0]


def train_layer(
    rows: DataFrame, settings: DenoiseSettings, below: list[TiedLayer] | None = None
) -> tuple[TiedLayer, list[float]]:
    """One layer on the samples of the layers below; returns it with the error per epoch."""
    # Every epoch reads the rows again: written once, none runs the caller's plan again.
    rows = sealed(rows, "denoise-rows")
    visible = len(below[-1].hidden_bias) if below else _width(rows)
    layer = TiedLayer.initial(visible, settings.hidden, settings.seed)
    errors = []
    for epoch in range(settings.epochs):
        sums = blocks.collect_sums(
            denoise_sums(rows, layer, settings.corruption, settings.seed + epoch, below)
        )
        layer = moved_layer(layer, sums, settings.learning_rate)
        errors.append(float(sums["n"][0][1] / sums["n"][0][0]))
    return layer, errors


def _project(rows: DataFrame, state, compute, **fields: str) -> DataFrame:
    bound = rows.sparkSession.sparkContext.broadcast(state)
    added = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in fields.values()]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = compute(bound.value, blocks.matrix(batch, "features"))
                yield blocks.with_columns(batch, dict(zip(fields.values(), values)))

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + added))


def reconstruct(rows: DataFrame, layer: TiedLayer) -> DataFrame:
    """``rows`` plus ``hidden`` and ``reconstructed``; a projection."""

    def compute(top, x):
        y = top.encode(x)
        return y, top.decode(y)

    return _project(rows, layer, compute, a="hidden", b="reconstructed")


# Softmax regression on one-hot targets.


@dataclass
class SoftmaxHead:
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def zero(cls, width: int, classes: int) -> SoftmaxHead:
        check_state_size(width * classes, "the softmax head")
        return cls(np.zeros((classes, width)), np.zeros(classes))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return blocks.softmax(x @ self.w.T + self.b)


def softmax_sums(
    rows: DataFrame, head: SoftmaxHead, seed: int = 0, below: list[TiedLayer] | None = None
) -> DataFrame:
    """Rows are (id, label one-hot array, features); sums of (y - p) x', (y - p), rows and log loss."""
    bound = rows.sparkSession.sparkContext.broadcast((head, below or []))

    def contribute(batch):
        top, lower = bound.value
        x = sampled_through(lower, blocks.matrix(batch, "features"), blocks.vector(batch, "id"), seed)
        y = blocks.matrix(batch, "label")
        p = top.scores(x)
        gap = y - p
        log_loss = -(y * np.log(np.maximum(p, 1e-300))).sum()
        return {"w": gap.T @ x, "b": gap.sum(axis=0), "n": np.array([len(x), log_loss])}

    return blocks.sum_over_rows(rows.select("id", "label", "features"), contribute)


def moved_head(head: SoftmaxHead, sums: dict[str, np.ndarray], rate: float) -> SoftmaxHead:
    scale = rate / sums["n"][0][0]
    return SoftmaxHead(head.w + scale * sums["w"], head.b + scale * sums["b"][0])


def train_head(
    rows: DataFrame, width: int, classes: int, rate: float, epochs: int, seed: int = 0, below: list[TiedLayer] | None = None
) -> SoftmaxHead:
    rows = sealed(rows, "head-rows")
    head = SoftmaxHead.zero(width, classes)
    for epoch in range(epochs):
        head = moved_head(head, blocks.collect_sums(softmax_sums(rows, head, seed + epoch, below)), rate)
    return head


def softmax_predict(rows: DataFrame, head: SoftmaxHead) -> DataFrame:
    return _project(rows, head, lambda h, x: (h.scores(x),), a="probabilities")


@dataclass
class StackedModel:
    layers: list[TiedLayer]
    head: SoftmaxHead
    errors: list[list[float]] = field(default_factory=list)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus ``probabilities``: expected activations upward, then softmax."""

        def compute(model, x):
            for layer in model.layers:
                x = layer.encode(x)
            return (model.head.scores(x),)

        return _project(rows, self, compute, a="probabilities")

    def save(self, spark: SparkSession, path: str) -> None:
        parts = [m for x in self.layers for m in (x.w, x.hidden_bias[None, :], x.visible_bias[None, :])]
        save_model(spark, path, "stacked", [*parts, self.head.w, self.head.b[None, :]], {"layers": len(self.layers)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StackedModel:
        parts, about = load_model(spark, path, "stacked")
        layers = [TiedLayer(parts[3 * k], parts[3 * k + 1][0], parts[3 * k + 2][0]) for k in range(about["layers"])]
        return cls(layers, SoftmaxHead(parts[-2], parts[-1][0]))


def train_stack(
    rows: DataFrame,
    hidden_sizes: list[int],
    classes: int,
    settings: DenoiseSettings,
    head_rate: float = 0.1,
    head_epochs: int = 100,
) -> StackedModel:
    """Greedy layer by layer, each on samples of the layers below, then the softmax head."""
    rows = sealed(rows, "stack-rows")
    layers: list[TiedLayer] = []
    errors = []
    for depth, hidden in enumerate(hidden_sizes):
        layer, found = train_layer(rows, settings.with_(hidden=hidden, seed=settings.seed + 1000 * depth), layers)
        layers.append(layer)
        errors.append(found)
    head = train_head(rows, hidden_sizes[-1], classes, head_rate, head_epochs, settings.seed, layers)
    return StackedModel(layers, head, errors)
