"""``pyspark.ml`` autoencoder trained by L-BFGS on distributed loss and gradient."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasBlockSize,
    HasInputCol,
    HasMaxIter,
    HasOutputCol,
    HasSeed,
    HasTol,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.operators.metrics import input_kind
from featherloom.plans import blocks, scoring
from featherloom.plans.feedforward import initial_weights, step_sums
from featherloom.plans.settings import NetworkSettings
from featherloom.session import release, seal
from featherloom.sources.models import load_model, save_model

#: Curvature pairs kept by the optimiser.
MEMORY = 10


class _Shared(HasInputCol, HasOutputCol, HasMaxIter, HasTol, HasBlockSize, HasSeed):
    layers = Param(Params._dummy(), "layers", "sizes including input and output", TypeConverters.toListInt)

    def getLayers(self) -> list[int]:
        return self.getOrDefault(self.layers)

    def _check(self, schema: T.StructType) -> None:
        if not isinstance(schema[self.getInputCol()].dataType, VectorUDT):
            raise ValueError(f"column {self.getInputCol()} must be a vector column")
        if self.getOutputCol() in schema.fieldNames():
            raise ValueError(f"column {self.getOutputCol()} already exists")


class Autoencoder(Estimator, _Shared):
    """Sigmoid network whose target is its input; ``fit`` gives the encoder."""

    @keyword_only
    def __init__(self, *, layers=None, inputCol=None, outputCol=None, maxIter=100, tol=1e-4, blockSize=128, seed=42):
        super().__init__()
        self._setDefault(maxIter=100, tol=1e-4, blockSize=128, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setLayers(self, value):
        return self._set(layers=value)

    def setInputCol(self, value):
        return self._set(inputCol=value)

    def setOutputCol(self, value):
        return self._set(outputCol=value)

    def setMaxIter(self, value):
        return self._set(maxIter=value)

    def setTol(self, value):
        return self._set(tol=value)

    def setBlockSize(self, value):
        return self._set(blockSize=value)

    def setSeed(self, value):
        return self._set(seed=value)

    def fit_pair(self, dataset: DataFrame) -> tuple[AutoencoderModel, AutoencoderModel]:
        """(encoder, decoder): all layers but the last, all layers but the first."""
        self._check(dataset.schema)
        sizes = self.getLayers()
        if len(sizes) < 3 or sizes[0] != sizes[-1]:
            raise ValueError("layers needs three or more sizes, the last equal to the first")
        settings = NetworkSettings(sizes=tuple(sizes), output="sigm", seed=self.getSeed())
        vectors = vector_to_array(self.getInputCol())
        rows = dataset.select(F.lit(0).cast("bigint").alias("id"), vectors.alias("label"), vectors.alias("features"))
        # Every evaluation reads the rows again: written once, none runs the caller's plan again.
        rows = seal(rows, "autoencoder-rows")
        kind = input_kind(rows, "features").first()["kind"]
        objective = _Objective(rows, settings, self.getBlockSize())
        point, history = minimise(
            objective, _flat(initial_weights(settings)), self.getMaxIter(), self.getTol()
        )
        weights = objective.shaped(point)
        release(rows)
        common = {"inputCol": self.getInputCol(), "outputCol": self.getOutputCol()}
        encoder = AutoencoderModel(sizes[:-1], weights[:-1], history, kind, **common)
        decoder = AutoencoderModel(sizes[1:], weights[1:], history, kind, **common)
        return encoder, decoder

    def _fit(self, dataset: DataFrame) -> AutoencoderModel:
        return self.fit_pair(dataset)[0]


class AutoencoderModel(Model, _Shared):
    def __init__(self, layers, weights, history=(), kind="real", inputCol=None, outputCol=None):
        super().__init__()
        self.weights = weights
        self.history = list(history)
        self.kind = kind
        self._set(layers=layers, inputCol=inputCol, outputCol=outputCol)

    def setInputCol(self, value):
        return self._set(inputCol=value)

    def setOutputCol(self, value):
        return self._set(outputCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds the vector column; a projection, also for streaming DataFrames."""
        self._check(dataset.schema)
        settings = NetworkSettings(sizes=tuple(self.getLayers()), output="sigm")
        encode = scoring.network(dataset.sparkSession, self.weights, settings)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(encode(vector_to_array(self.getInputCol()))))

    def save(self, spark: SparkSession, path: str) -> None:
        about = {"inputCol": self.getInputCol(), "outputCol": self.getOutputCol(), "kind": self.kind}
        save_model(spark, path, "autoencoder", self.weights, {**about, "layers": self.getLayers()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AutoencoderModel:
        weights, about = load_model(spark, path, "autoencoder")
        return cls(
            about["layers"], weights, kind=about["kind"], inputCol=about["inputCol"], outputCol=about["outputCol"]
        )


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


class _Objective:
    """Half mean squared error and its gradient; one Spark job per evaluation."""

    def __init__(self, rows: DataFrame, settings: NetworkSettings, block_size: int):
        self.rows, self.settings, self.block_size = rows, settings, block_size
        self.shapes = [(o, i + 1) for i, o in zip(settings.sizes, settings.sizes[1:])]

    def shaped(self, point: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([a * b for a, b in self.shapes])[:-1]
        return [part.reshape(shape) for part, shape in zip(np.split(point, cuts), self.shapes)]

    def __call__(self, point: np.ndarray) -> tuple[float, np.ndarray]:
        weights = self.shaped(point)
        found = step_sums(self.rows, weights, self.settings, training=False, block_size=self.block_size)
        sums = blocks.collect_sums(found)
        squared, n = sums["loss"][0]
        return 0.5 * squared / n, _flat([sums[f"w{k}"] / n for k in range(len(self.shapes))])


def minimise(objective, start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with a backtracking line search; only model-sized vectors on the driver.

    Stops when the loss improves by less than ``tol`` relative to its size.
    """
    x = start
    value, gradient = objective(x)
    history = [value]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        direction = -_inverse_hessian_times(gradient, pairs)
        slope = float(direction @ gradient)
        if slope >= 0:
            pairs, direction = [], -gradient
            slope = -float(gradient @ gradient)
        if slope == 0:
            break
        size = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(gradient))
        for _ in range(20):
            candidate, candidate_gradient = objective(x + size * direction)
            if candidate <= value + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        s, y = size * direction, candidate_gradient - gradient
        if float(s @ y) > 1e-12:
            pairs = (pairs + [(s, y)])[-MEMORY:]
        gain = value - candidate
        x, value, gradient = x + s, candidate, candidate_gradient
        history.append(value)
        if gain <= tol * max(abs(value), 1e-12):
            break
    return x, history


def _inverse_hessian_times(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q = gradient.copy()
    used = []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(s @ y)
        q -= a * y
        used.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(pairs, reversed(used)):
        q += (a - float(y @ q) / float(s @ y)) * s
    return q
