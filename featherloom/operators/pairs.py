"""Consecutive pairs inside a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featherloom.operators.joins import HOT_FLOOR, hot_of


def consecutive_pairs(
    rows: DataFrame, key: str, order: str, value: str, span: int = 1_000_000, floor: int = HOT_FLOOR
) -> DataFrame:
    """(key, order, previous, current) for each row and the row before it.

    ``order`` is a unique non-negative integer.  Keys are counted first.  Those that hold a
    large share of more than ``floor`` rows are cut into spans of the order column; all
    others are paired by one window per key.
    """
    hot = hot_of(rows, key, floor=floor).table
    if hot is None:
        return _whole_keys(rows, key, order, value)
    hot = F.broadcast(hot.select(key))
    few = _whole_keys(rows.join(hot, key, "left_anti"), key, order, value)
    return few.unionByName(_by_spans(rows.join(hot, key, "left_semi"), key, order, value, span))


def _whole_keys(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    inside = Window.partitionBy(key).orderBy(order)
    paired = rows.select(key, order, value, F.lag(value).over(inside).alias("previous"), F.row_number().over(inside).alias("_n"))
    return paired.where(F.col("_n") > 1).select(key, order, "previous", F.col(value).alias("current"))


def _by_spans(rows: DataFrame, key: str, order: str, value: str, span: int) -> DataFrame:
    """Pairs of keys too large for one window.

    The window runs per key and per ``span`` of the order column, so a partition
    never holds more than ``span`` rows.  The first row of each span is then paired
    through a table with one row per (key, span).
    """
    cells = rows.select(key, order, value, F.floor(F.col(order) / span).alias("_span"))
    inside = Window.partitionBy(key, "_span").orderBy(order)
    paired = cells.withColumn("previous", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    within = paired.where(~F.col("_first")).select(key, order, "previous", F.col(value).alias("current"))
    edges = cells.groupBy(key, "_span").agg(
        F.min(order).alias("first_order"),
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
    )
    across = Window.partitionBy(key).orderBy("_span")
    stitched = (
        edges.withColumn("previous", F.lag("last_value").over(across))
        .withColumn("_seen", F.row_number().over(across) > 1)
        .where("_seen")
        .select(key, F.col("first_order").alias(order), "previous", F.col("first_value").alias("current"))
    )
    return within.unionByName(stitched)
