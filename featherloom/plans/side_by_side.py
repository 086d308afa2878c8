"""Many linear SVMs over the same rows, trained side by side: folds of a cross-validation, shares of a sweep.

A step is one job for all models.  A task reads a batch once, multiplies it with all weights, and a mask of (rows, models)
says which rows each model learns from; gradients are summed by model.  Every model follows the rule of :mod:`svm`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.functions.seeded import Draw
from featherloom.operators.splits import cell, fold_column
from featherloom.plans import blocks
from featherloom.plans.settings import SvmSettings
from featherloom.plans.svm import require_binary
from featherloom.session import check_state_size, release, seal


@dataclass(frozen=True)
class Masks:
    """Which of ``count`` models a row trains, from one ``array<boolean>`` expression."""

    expression: Column
    count: int

    @classmethod
    def folds(cls, fold: Column, count: int) -> Masks:
        """Model k learns from all folds but k."""
        return cls(F.array(*[fold != k for k in range(count)]), count)

    @classmethod
    def shares(cls, row_id: str, shares: list[float], draws: list[Draw]) -> Masks:
        """Model k learns from ``shares[k]`` of the rows, by a draw of its own."""
        if len(shares) != len(draws) or not all(0.0 < s <= 1.0 for s in shares):
            raise ValueError("every share in (0, 1] needs a draw")
        return cls(F.array(*[cell(draw, row_id) < share for share, draw in zip(shares, draws)]), len(shares))


def _mask(batch: pa.RecordBatch, count: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("mask")).flatten().to_numpy(zero_copy_only=False)
    return values.astype(bool).reshape(batch.num_rows, count)


def hinge_sums(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(name, unit, w) over (label, features, mask): ``g`` is the summed gradient and ``n`` the row count of model ``unit``."""
    bound = rows.sparkSession.sparkContext.broadcast(weights)

    def contribute(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        w = bound.value
        x = blocks.matrix(batch, "features")
        s = 2.0 * blocks.vector(batch, "label").astype(float) - 1.0
        taken = _mask(batch, len(w))
        pull = np.where(taken & (s[:, None] * (x @ w.T) < 1.0), -s[:, None], 0.0)
        return {"g": pull.T @ x, "n": taken.sum(axis=0, dtype=np.float64)[:, None]}

    return blocks.sum_over_rows(rows.select("label", "features", "mask"), contribute)


def train(rows: DataFrame, masks: Masks, settings: SvmSettings) -> np.ndarray:
    """(models, width): weights after ``settings.iterations`` steps from zero on (id, label 0/1, features).

    A model stops moving when its step falls below ``settings.tolerance``, as in :func:`svm.train`; one without rows keeps
    its zeros.
    """
    if settings.fraction != 1.0:
        raise ValueError("the masks say which rows are learned from; fraction must be 1")
    data = rows.select(require_binary("label").alias("label"), F.col("features").cast("array<double>").alias("features"), masks.expression.alias("mask"))
    data = seal(data, "masked-rows")
    first = data.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows to train on")
    check_state_size(masks.count * first[0], "the models")
    w = np.zeros((masks.count, first[0]))
    moving = np.ones(masks.count, bool)
    for t in range(1, settings.iterations + 1):
        sums = blocks.collect_sums(hinge_sums(data, w))
        n = sums["n"][:, :1]
        rate = settings.step / np.sqrt(t)
        new = w * (1.0 - rate * settings.reg) - rate * sums["g"] / np.maximum(n, 1.0)
        new = np.where((moving & (n[:, 0] > 0))[:, None], new, w)
        if t > 1:
            change, size = np.linalg.norm(new - w, axis=1), np.linalg.norm(new, axis=1)
            moving &= change >= settings.tolerance * np.maximum(size, 1.0)
        w = new
        if not moving.any():
            break
    release(data)
    return w


def margins(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` plus ``margins``, one for each model: a projection."""
    bound = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield blocks.with_columns(batch, {"margins": blocks.matrix(batch, "features") @ bound.value.T})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", margins array<double>")


def cross_validate(rows: DataFrame, folds: int, draw: Draw, settings: SvmSettings, row_id: str = "id") -> DataFrame:
    """(id, fold, label, margin): every row scored by the model that has not seen its fold."""
    fold = fold_column(row_id, folds, draw)
    weights = train(rows, Masks.folds(fold, folds), settings)
    ready = rows.select(row_id, fold.alias("fold"), "label", F.col("features").cast("array<double>").alias("features"))
    return margins(ready, weights).select(row_id, "fold", "label", F.get("margins", F.col("fold")).alias("margin"))


def fold_errors(scored: DataFrame) -> DataFrame:
    """(fold, rows, error_rate) of :func:`cross_validate`, the threshold being 0."""
    wrong = ((F.col("margin") > 0).cast("int") != F.col("label").cast("int")).cast("double")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(wrong).alias("error_rate"))


def sweep(rows: DataFrame, shares: list[float], draws: list[Draw], settings: SvmSettings, row_id: str = "id") -> DataFrame:
    """(train_share, id, label, margin): for every share the rows its model has not seen, scored by it."""
    masks = Masks.shares(row_id, shares, draws)
    weights = train(rows, masks, settings)
    ready = rows.select(row_id, "label", F.col("features").cast("array<double>").alias("features"), masks.expression.alias("mask"))
    told = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("train_share"), F.col("mask").alias("seen"), F.col("margins").alias("margin"))
    cells = margins(ready, weights).select(row_id, "label", F.inline(told))
    return cells.where(~F.col("seen")).select("train_share", row_id, "label", "margin")


