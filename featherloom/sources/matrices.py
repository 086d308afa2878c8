"""Sparse matrices: Parquet (i, j, v), zeros left out; a folder of part files is one matrix.

``v`` keeps the type it has; the indices are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.operators.matmul import checked

def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), "v").where("v <> 0").write.parquet(path)


def read_matrix(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(i, j, v); with the dimensions given, an index outside them fails the job."""
    matrix = spark.read.parquet(path).select("i", "j", "v")
    if n_rows is not None and n_cols is not None:
        matrix = checked(matrix, n_rows, n_cols)
    return matrix
