"""Models as functions of a vector column: Arrow scalar functions with broadcast weights.

The planner sees an expression, so it prunes columns and moves filters below it; it stands in a select, in SQL text (after
``spark.udf.register``) and in streams.  Nothing but the vector itself goes through Python, and no weight is in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from featherloom.plans import blocks
from featherloom.plans.feedforward import forward_block
from featherloom.plans.settings import NetworkSettings


def over_vectors(x: pa.Array, apply: Callable[[np.ndarray], np.ndarray], kind: pa.DataType) -> pa.Array:
    """``apply`` on the vectors that are not null, as one matrix; null elsewhere."""
    there = pc.is_valid(x)
    found = apply(blocks.stacked(x.filter(there), "the vector column")) if x.null_count < len(x) else None
    if found is None:
        return pa.nulls(len(x), kind)
    told = blocks.array_column(found) if found.ndim == 2 else pa.array(found)
    if not x.null_count:
        return told
    place = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
    return told.take(pa.array(place, mask=~there.to_numpy(zero_copy_only=False)))


def linear(spark: SparkSession, weights: np.ndarray, intercept: float) -> Callable[..., Column]:
    """array<double> -> the margin of a linear model."""
    bound = spark.sparkContext.broadcast(weights)

    def margin(x: pa.Array) -> pa.Array:
        return over_vectors(x, lambda rows: rows @ bound.value + intercept, pa.float64())

    return F.arrow_udf(margin, "double")


def network(spark: SparkSession, weights: list[np.ndarray], settings: NetworkSettings) -> Callable[..., Column]:
    """array<double> -> the outputs of a network in test mode."""
    bound = spark.sparkContext.broadcast([w.astype(settings.dtype) for w in weights])

    def outputs(x: pa.Array) -> pa.Array:
        return over_vectors(x, lambda rows: forward_block(rows.astype(settings.dtype), bound.value, settings).output, pa.list_(pa.float64()))

    return F.arrow_udf(outputs, "array<double>")
