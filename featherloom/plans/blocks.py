"""Array columns as NumPy blocks inside Arrow tasks, and distributed sums of blocks.

Spark partitions and shuffles; a task only turns one Arrow batch into matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUM_SCHEMA = "name STRING, unit INT, w ARRAY<DOUBLE>"

#: Tasks whose partial sums are added together first.
FAN_IN = 32

#: One Arrow batch -> named arrays (vectors or matrices) to be added up.
Contribution = Callable[[pa.RecordBatch], dict[str, np.ndarray]]


def matrix(batch: pa.RecordBatch, name: str, dtype=np.float64) -> np.ndarray:
    """(rows, width) from an array column whose rows all have the same length."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        raise ValueError(f"column {name} holds NULL vectors")
    return stacked(column, f"column {name}", dtype)


def stacked(column: pa.Array, what: str = "the column", dtype=np.float64) -> np.ndarray:
    """(rows, width) from lists of the same length, none of them null."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) == 0:
        return np.empty((0, 0), dtype)
    if (sizes != sizes[0]).any():
        raise ValueError(f"{what} holds vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(sizes), sizes[0])


def vector(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def array_column(values: np.ndarray) -> pa.ListArray:
    """(rows, width) -> array<double> column."""
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.float64).reshape(-1)))


def with_columns(batch: pa.RecordBatch, added: dict[str, np.ndarray]) -> pa.RecordBatch:
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, values in added.items():
        names.append(name)
        arrays.append(array_column(values) if values.ndim == 2 else pa.array(values))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def sum_over_rows(rows: DataFrame, contribute: Contribution, block_size: int | None = None) -> DataFrame:
    """(name, unit, w): the contributions of all rows, added up.

    ``block_size`` bounds the rows handed to ``contribute`` at once; by default it
    gets whole Arrow batches.

    A task adds its batches first and emits one row per matrix row, so the shuffle
    carries the size of the result times the number of tasks, never the data.  The
    splits stay as they are read: a lost task repeats one split.
    """

    def partial(batches):
        acc: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size = block_size or batch.num_rows
            for start in range(0, batch.num_rows, size):
                for name, value in contribute(batch.slice(start, size)).items():
                    value = np.atleast_2d(np.asarray(value, dtype=np.float64))
                    acc[name] = acc[name] + value if name in acc else value
        yield sum_rows(acc)

    return added_up(rows.mapInArrow(partial, SUM_SCHEMA))


def sum_rows(acc: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Named matrices as rows of ``SUM_SCHEMA``."""
    names = [n for n, m in acc.items() for _ in range(len(m))]
    units = [u for m in acc.values() for u in range(len(m))]
    arrays = [row for m in acc.values() for row in m]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(units, pa.int32()), pa.array(arrays, pa.list_(pa.float64()))],
        names=["name", "unit", "w"],
    )


def added_up(partials: DataFrame) -> DataFrame:
    """Partial sums of all tasks added in two levels, spread over all units.

    The sums of ``FAN_IN`` neighbouring tasks meet first, and what they come to is added
    once more: no task reads a row from every other, however many splits the data has.
    """
    group = F.floor(F.spark_partition_id() / FAN_IN)

    def total(table: DataFrame, *keys: str) -> DataFrame:
        sums = table.groupBy(*keys).agg(Summarizer.sum(array_to_vector(F.col("w"))).alias("_v"))
        return sums.select(*keys, vector_to_array("_v").alias("w"))

    return total(total(partials.withColumn("_group", group), "name", "unit", "_group"), "name", "unit")


def collect_sums(sums: DataFrame) -> dict[str, np.ndarray]:
    """The summed blocks on the driver; callers check their size against the state limit."""
    found: dict[str, list] = {}
    for row in sorted(sums.collect(), key=lambda r: (r["name"], r["unit"])):
        found.setdefault(row["name"], []).append(row["w"])
    return {name: np.array(values) for name, values in found.items()}


def cell_draws(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """(rows, width) uniform draws in [0, 1), a mix of (row id, position, seed).

    Independent of batch and partition boundaries, so a retried task repeats them.
    """
    with np.errstate(over="ignore"):
        key = ids.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        key = key + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        key = key + np.uint64(seed % (1 << 64)) * np.uint64(0x8CB92BA72F3D8DD7)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
        key = key ^ (key >> np.uint64(31))
    return (key >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
