"""Activation functions, their derivatives and guarded exponentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featherloom.functions.vectors import ColumnLike, as_col, let, total

# The scaled hyperbolic tangent 1.7159 * tanh(2x/3).
TANH_GAIN = 1.7159
TANH_SLOPE = 2.0 / 3.0


def sigmoid(x: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(x)))


def sigmoid_all(a: ColumnLike) -> Column:
    return F.transform(as_col(a), sigmoid)


def sigmoid_slope(activation: ColumnLike) -> Column:
    """Derivative of the sigmoid, written in its own output."""
    a = as_col(activation)
    return a * (1.0 - a)


def scaled_tanh(x: ColumnLike) -> Column:
    return F.tanh(as_col(x) * TANH_SLOPE) * TANH_GAIN


def scaled_tanh_slope(activation: ColumnLike) -> Column:
    a = as_col(activation)
    return TANH_GAIN * TANH_SLOPE * (1.0 - a * a / (TANH_GAIN * TANH_GAIN))


def softmax_all(a: ColumnLike) -> Column:
    """Softmax over one array, shifted by its maximum so that exp cannot overflow."""
    c = as_col(a)
    shifted = let(F.array_max(c), lambda top: F.transform(c, lambda x: F.exp(x - top)))
    return let(shifted, lambda es: let(total(es), lambda s: F.transform(es, lambda e: e / s)))


def log1p_exp(x: ColumnLike) -> Column:
    """log(1 + e^x) that does not overflow for large positive x."""
    c = as_col(x)
    return F.when(c > 0, c + F.log1p(F.exp(-c))).otherwise(F.log1p(F.exp(c)))
