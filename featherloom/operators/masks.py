"""Random masks with per-cell draws: input noise, binary corruption, dropout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featherloom.functions.seeded import Draw
from featherloom.functions.vectors import ColumnLike, as_col, multiply, scale


def _check_share(share: float) -> None:
    if not 0.0 <= share <= 1.0:
        raise ValueError(f"share must lie in [0, 1], got {share}")


def zero_mask(a: ColumnLike, row_id: ColumnLike, fraction: float, draw: Draw) -> Column:
    """Keep an entry when its draw is at least ``fraction``, else set it to 0."""
    _check_share(fraction)
    rid = as_col(row_id)
    return F.transform(as_col(a), lambda x, i: F.when(draw(rid, i) >= fraction, x).otherwise(0.0))


def binary_corruption(a: ColumnLike, row_id: ColumnLike, level: float, draw: Draw) -> Column:
    """0 stays 0; a 1 survives with probability 1 - level."""
    _check_share(level)
    rid = as_col(row_id)
    return F.transform(
        as_col(a),
        lambda x, i: F.when(x == 0, 0.0).when(draw(rid, i) < 1.0 - level, 1.0).otherwise(0.0),
    )


def dropout_mask(a: ColumnLike, row_id: ColumnLike, fraction: float, draw: Draw) -> Column:
    """1.0 where the unit stays (draw above ``fraction``), else 0.0."""
    _check_share(fraction)
    rid = as_col(row_id)
    return F.transform(as_col(a), lambda x, i: F.when(draw(rid, i) > fraction, 1.0).otherwise(0.0))


def dropout_train(a: ColumnLike, row_id: ColumnLike, fraction: float, draw: Draw) -> Column:
    """struct(mask, masked): the mask is needed again in the backward pass."""
    mask = dropout_mask(a, row_id, fraction, draw)
    return F.struct(mask.alias("mask"), multiply(a, mask).alias("masked"))


def dropout_test(a: ColumnLike, fraction: float) -> Column:
    """Expected value of the masked entry: everything times 1 - fraction."""
    _check_share(fraction)
    return scale(a, 1.0 - fraction)
