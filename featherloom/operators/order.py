"""Ordering operators: whole-table shuffle, first rows, preview of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.functions.seeded import Draw
from featherloom.operators.splits import cell
from featherloom.session import seal

# Fixed value: rows shown by the preview.
PREVIEW_ROWS = 200


def shuffled(rows: DataFrame, row_id: str, draw: Draw, share: float = 1.0) -> DataFrame:
    """Rows in random order (a range-partitioned sort by draw).

    With ``share`` below 1 only that share of the rows moves to random places;
    the others keep their id order after them.
    """
    u = cell(draw, row_id)
    key = u if share >= 1.0 else F.when(u < share, u).otherwise(F.lit(1.0))
    return rows.withColumn("shuffle_key", key).orderBy("shuffle_key", row_id)


def first_rows(rows: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def preview(predictions: DataFrame, row_id: str, label: str, predicted: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows with actual value, predicted value and their difference."""
    return first_rows(predictions, [row_id], n).select(
        row_id,
        F.col(label).alias("actual"),
        F.col(predicted).alias("predicted"),
        (F.col(predicted) - F.col(label)).alias("difference"),
    )


def numbered(table: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``table``, written out, with a column ``name`` of dense numbers from 0, and its number of rows.

    Rows are numbered where they lie: what moves is one count per task that wrote them.
    """
    placed = seal(table.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_at", 33)
    runs = placed.groupBy(part.alias("part")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    shifts, rows = [], 0
    for run in sorted(runs):
        shifts.append((run["part"], run["first"] - rows))
        rows += run["n"]
    listed = table.sparkSession.createDataFrame(shifts, "_part BIGINT, _shift BIGINT")
    found = placed.withColumn("_part", part).join(F.broadcast(listed), "_part")
    found = found.withColumn(name, F.col("_at") - F.col("_shift")).select(*table.columns, name)
    found._sealed_at = placed._sealed_at
    return found, rows
