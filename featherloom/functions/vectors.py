"""Array-of-double algebra as Catalyst expressions (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A row-level aggregate written inside a ``transform`` lambda would run again
    for every element; bound as a lambda variable it runs once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(c: ColumnLike) -> Column:
    return as_col(c).cast("array<double>")


def add(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x + y)


def subtract(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x - y)


def multiply(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x * y)


def scale(a: ColumnLike, factor: ColumnLike | float) -> Column:
    by = factor if isinstance(factor, (Column, float, int)) else F.col(factor)
    return F.transform(as_col(a), lambda x: x * by)


def total(a: ColumnLike) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product; NULL when the lengths differ, because zip_with pads with NULL."""
    return total(multiply(a, b))


def margin(weights: ColumnLike, features: ColumnLike, intercept: float = 0.0) -> Column:
    return dot(weights, features) + F.lit(float(intercept))


def squared_norm(a: ColumnLike) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + x * x)


def squared_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Exact squared Euclidean distance."""
    return F.aggregate(
        F.zip_with(as_col(a), as_col(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def squared_distance_by_norms(
    a: ColumnLike,
    b: ColumnLike,
    norm_a: ColumnLike,
    norm_b: ColumnLike,
    precision: float = 1e-6,
) -> Column:
    """Squared distance from precomputed norms where that is accurate enough.

    ``|a|^2 + |b|^2 - 2ab`` cancels when the two norms are close.  Its relative
    error is bounded by ``2 eps (|a|^2+|b|^2) / (|a|-|b|)^2``; rows above
    ``precision`` take the exact sum instead.
    """
    eps = 2.0**-52
    na, nb = as_col(norm_a), as_col(norm_b)
    squares = na * na + nb * nb
    bound = 2.0 * eps * squares / ((na - nb) * (na - nb) + eps)
    return F.when(bound < precision, squares - 2.0 * dot(a, b)).otherwise(squared_distance(a, b))


def append_one(a: ColumnLike) -> Column:
    """Bias slot in last place."""
    return F.concat(as_col(a), F.array(F.lit(1.0)))


def prepend_one(a: ColumnLike) -> Column:
    """Bias slot in first place."""
    return F.concat(F.array(F.lit(1.0)), as_col(a))


def drop_first(a: ColumnLike) -> Column:
    c = as_col(a)
    return F.slice(c, F.lit(2), F.size(c) - 1)


def require_same_size(a: ColumnLike, b: ColumnLike) -> Column:
    """``a`` itself, or an error for rows whose vectors differ in length."""
    ca, cb = as_col(a), as_col(b)
    return F.when(F.size(ca) == F.size(cb), ca).otherwise(
        F.raise_error(
            F.concat(F.lit("vector sizes differ: "), F.size(ca).cast("string"), F.lit(" and "), F.size(cb).cast("string"))
        ).cast("array<double>")
    )


def row_range(a: ColumnLike) -> Column:
    c = as_col(a)
    return F.array_max(c) - F.array_min(c)


def range_scaled(a: ColumnLike) -> Column:
    """Each value over the row's max-min; NULL entries for a constant row."""
    c = as_col(a)
    return let(F.nullif(row_range(c), F.lit(0.0)), lambda r: F.transform(c, lambda v: v / r))


def range_shifted(a: ColumnLike) -> Column:
    """(x - r) / r with r the row's range: the range, not the minimum, is taken off."""
    c = as_col(a)
    return let(F.nullif(row_range(c), F.lit(0.0)), lambda r: F.transform(c, lambda v: (v - r) / r))


def to_entries(a: ColumnLike, keep_zeros: bool = False, base: int = 0) -> Column:
    """Dense array -> array<struct<idx,val>>, without the zeros by default."""
    pairs = F.transform(
        as_col(a), lambda x, i: F.struct((i + base).cast("int").alias("idx"), x.cast("double").alias("val"))
    )
    return pairs if keep_zeros else F.filter(pairs, lambda e: e["val"] != 0.0)


def from_entries(entries: ColumnLike, width: int, base: int = 0) -> Column:
    """array<struct<idx,val>> -> dense array of ``width``; indices must be unique."""
    slots = F.sequence(F.lit(base), F.lit(base + width - 1))
    return let(
        F.map_from_entries(as_col(entries)),
        lambda values: F.transform(slots, lambda k: F.coalesce(F.element_at(values, k), F.lit(0.0))),
    )


def is_strictly_ascending(indices: ColumnLike) -> Column:
    """True when every index is greater than the one before it."""
    c = as_col(indices)
    later = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    earlier = F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    return F.forall(F.zip_with(earlier, later, lambda p, q: p < q), lambda ok: ok)


def ceil_to_tenth(c: ColumnLike) -> Column:
    return F.ceil(as_col(c) * 10.0) / 10.0
