"""Synthetic regression samples with reproducible cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.functions.seeded import Draw, hashed, uniform_array
from featherloom.functions.surfaces import surface


def samples_for(
    ids: DataFrame, row_id: str, width: int, low: float, high: float, function: str, draw: Draw
) -> DataFrame:
    """(row id, y, x): per id ``width`` uniform coordinates in [low, high) and y = function(x)."""
    points = ids.select(row_id, uniform_array(draw, row_id, width, low, high).alias("x"))
    return points.select(row_id, surface(function, "x").alias("y"), "x")


def random_samples(
    spark: SparkSession,
    n_rows: int,
    width: int,
    low: float = -1.0,
    high: float = 1.0,
    function: str = "sphere",
    seed: int = 42,
    partitions: int | None = None,
) -> DataFrame:
    """``n_rows`` samples (id, y, x), generated where they are used."""
    ids = spark.range(0, n_rows, 1, partitions) if partitions else spark.range(n_rows)
    return samples_for(ids, "id", width, low, high, function, hashed(seed))


def from_memory(spark: SparkSession, rows, schema, partitions: int) -> DataFrame:
    """Small driver-side rows as a DataFrame of ``partitions`` partitions."""
    return spark.createDataFrame(rows, schema).repartition(partitions)


def as_training_rows(samples: DataFrame, row_id: str = "id") -> DataFrame:
    """(id, label array, features array), the layout the networks train on."""
    return samples.select(F.col(row_id).alias("id"), F.array("y").alias("label"), F.col("x").alias("features"))
