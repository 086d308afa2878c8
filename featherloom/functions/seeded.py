"""Reproducible draws per cell.

``rand()`` depends on the partitioning of a plan, so a recomputed task would draw
other numbers.  A draw here is a hash of (row id, position, seed): the same on any
partitioning, any retry and any cluster size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from featherloom.functions.vectors import ColumnLike, as_col

#: (row id, position) -> a number in [0, 1)
Draw = Callable[[Column, Column], Column]


def hashed(seed: int) -> Draw:
    """53-bit uniform draw from xxhash64."""

    def draw(row_id: Column, position: Column) -> Column:
        h = F.xxhash64(row_id, position, F.lit(int(seed)))
        return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)

    return draw


def modular(seed: int, modulus: int = 1000) -> Draw:
    """Draw from integer arithmetic alone, so that another SQL engine can repeat it."""

    def draw(row_id: Column, position: Column) -> Column:
        linear = row_id.cast("bigint") * 7919 + position.cast("bigint") * 104729 + int(seed)
        mixed = F.pmod(linear, F.lit(1_000_003))
        return F.pmod(mixed * mixed + mixed * 31, F.lit(modulus)).cast("double") / float(modulus)

    return draw


def uniform(draw: Draw, row_id: ColumnLike, position: ColumnLike, low: float, high: float) -> Column:
    return draw(as_col(row_id), as_col(position)) * (high - low) + low


def uniform_array(draw: Draw, row_id: ColumnLike, width: int, low: float, high: float) -> Column:
    rid = as_col(row_id)
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda k: draw(rid, k) * (high - low) + low
    )


def bernoulli(draw: Draw, row_id: ColumnLike, position: ColumnLike, p: ColumnLike | float) -> Column:
    """1.0 with probability ``p``; 0.0 whenever ``p`` lies outside [0, 1]."""
    prob = F.lit(float(p)) if isinstance(p, (int, float)) else as_col(p)
    hit = draw(as_col(row_id), as_col(position)) < prob
    return F.when(hit & prob.between(0.0, 1.0), 1.0).otherwise(0.0)
