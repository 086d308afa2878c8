"""Random splits, folds and mini-batches, all as one bucket column per row.

A draw per row id places the row; pieces are disjoint and complete, the same on
every recomputation, and need no shuffle and no second copy of the data.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.functions.seeded import Draw
from featherloom.functions.vectors import ColumnLike, as_col


def cell(draw: Draw, row_id: ColumnLike) -> Column:
    """The row's number in [0, 1)."""
    return draw(as_col(row_id), F.lit(0))


def split_column(row_id: ColumnLike, weights: list[float], draw: Draw) -> Column:
    """Index of the piece each row falls into; weights are normalised."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    bounds = [w / sum(weights) for w in accumulate(weights)]
    u = cell(draw, row_id)
    piece = F.lit(len(weights) - 1)
    for index in range(len(weights) - 2, -1, -1):
        piece = F.when(u < bounds[index], index).otherwise(piece)
    return piece


def random_split(rows: DataFrame, row_id: str, weights: list[float], draw: Draw) -> list[DataFrame]:
    marked = rows.withColumn("_piece", split_column(row_id, weights, draw))
    return [marked.where(F.col("_piece") == i).drop("_piece") for i in range(len(weights))]


def train_validation(rows: DataFrame, row_id: str, share: float, draw: Draw) -> tuple[DataFrame, DataFrame]:
    """``share`` of the rows (0 <= share < 1) held out for validation."""
    if not 0.0 <= share < 1.0:
        raise ValueError("validation share must lie in [0, 1)")
    train, valid = random_split(rows, row_id, [1.0 - share, share], draw)
    return train, valid


def batch_column(row_id: ColumnLike, n_batches: int, draw: Draw) -> Column:
    """One batch number per row per epoch; vary the draw's seed by epoch."""
    if n_batches < 1:
        raise ValueError("at least one batch is needed")
    return F.floor(cell(draw, row_id) * n_batches).cast("int")


def fold_column(row_id: ColumnLike, folds: int, draw: Draw) -> Column:
    if folds < 2:
        raise ValueError("at least two folds are needed")
    return F.floor(cell(draw, row_id) * folds).cast("int")


def k_fold(rows: DataFrame, row_id: str, folds: int, draw: Draw) -> list[tuple[DataFrame, DataFrame]]:
    """(training, validation) per fold; the validation parts cover every row once."""
    marked = rows.withColumn("_fold", fold_column(row_id, folds, draw))
    return [
        (marked.where(F.col("_fold") != i).drop("_fold"), marked.where(F.col("_fold") == i).drop("_fold"))
        for i in range(folds)
    ]
