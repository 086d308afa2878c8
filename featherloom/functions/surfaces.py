"""Optimisation test surfaces over an array of coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from featherloom.functions.vectors import ColumnLike, as_col, squared_norm, total


def sphere(x: ColumnLike) -> Column:
    return squared_norm(x)


def rastrigin(x: ColumnLike) -> Column:
    return total(F.transform(as_col(x), lambda v: v * v - 10.0 * F.cos(2.0 * math.pi * v) + 10.0))


def rosenbrock(x: ColumnLike) -> Column:
    c = as_col(x)
    steps = F.greatest(F.size(c) - 1, F.lit(0))
    head, tail = F.slice(c, F.lit(1), steps), F.slice(c, F.lit(2), steps)
    terms = F.zip_with(
        head, tail, lambda a, b: 100.0 * (b - a * a) * (b - a * a) + (a - 1.0) * (a - 1.0)
    )
    return total(terms)


SURFACES = {"rosenbrock": rosenbrock, "rastrigin": rastrigin, "sphere": sphere}


def surface(name: str, x: ColumnLike) -> Column:
    if name not in SURFACES:
        raise ValueError(f"unknown surface {name!r}; choose one of {sorted(SURFACES)}")
    return SURFACES[name](x)
