"""Model persistence: a Parquet table of weights and a one-row JSON description."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.session import check_state_size

# Format name and version written with every model.
FORMAT = "featherloom-model"
VERSION = 1


def weight_rows(matrices: list[np.ndarray]) -> list[tuple[int, int, list[float]]]:
    return [
        (layer, unit, row.astype(float).tolist())
        for layer, matrix in enumerate(matrices)
        for unit, row in enumerate(matrix)
    ]


def weight_table(spark: SparkSession, matrices: list[np.ndarray]) -> DataFrame:
    """(layer, unit, w): one row per output unit."""
    check_state_size(sum(m.size for m in matrices), "the weight table")
    return spark.createDataFrame(weight_rows(matrices), "layer INT, unit INT, w ARRAY<DOUBLE>")


def save_model(spark: SparkSession, path: str, kind: str, matrices: list[np.ndarray], settings: dict) -> None:
    weight_table(spark, matrices).coalesce(1).write.parquet(f"{path}/weights")
    about = {"format": FORMAT, "version": VERSION, "kind": kind, "settings": settings}
    spark.createDataFrame([(json.dumps(about),)], "value STRING").coalesce(1).write.text(f"{path}/about")


def save_table_model(spark: SparkSession, path: str, kind: str, table: DataFrame, settings: dict) -> None:
    """A model whose weights are a table of any size, and its description."""
    table.write.parquet(f"{path}/table")
    about = {"format": FORMAT, "version": VERSION, "kind": kind, "settings": settings}
    spark.createDataFrame([(json.dumps(about),)], "value STRING").coalesce(1).write.text(f"{path}/about")


def load_table_model(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    """Weight table and settings; another kind, format or version is refused."""
    about = _described(spark, path, kind)
    return spark.read.parquet(f"{path}/table"), about["settings"]


def _described(spark: SparkSession, path: str, kind: str) -> dict:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    found = (about.get("format"), about.get("version"), about.get("kind"))
    if found != (FORMAT, VERSION, kind):
        raise ValueError(f"cannot load {found} as {(FORMAT, VERSION, kind)}")
    return about


def load_model(spark: SparkSession, path: str, kind: str) -> tuple[list[np.ndarray], dict]:
    """Weights and settings; another kind, format or version is refused."""
    about = _described(spark, path, kind)
    table = spark.read.schema("layer INT, unit INT, w ARRAY<DOUBLE>").parquet(f"{path}/weights")
    size = table.agg(F.sum(F.size("w"))).first()[0] or 0
    check_state_size(size, "the stored model")
    layers: dict[int, list] = {}
    for row in table.orderBy("layer", "unit").toLocalIterator():
        layers.setdefault(row["layer"], []).append(row["w"])
    return [np.array(layers[k]) for k in sorted(layers)], about["settings"]
