"""Session conventions: shared scratch space, lineage cuts, bounded driver state."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession

#: Largest model state (weights, gradients, column bounds) that may pass through
#: the driver or a broadcast.  Data never does; beyond this the weight-table
#: form of an operator must be used.
MAX_STATE_BYTES = 256 * 1024 * 1024

#: Names this run's part of the shared folder.
RUN = uuid.uuid4().hex


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="featherloom-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary folder; on a
    cluster a machine-local folder would lose data with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/featherloom-{RUN}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this run's part of the shared folder."""
    return f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def clean(spark: SparkSession) -> None:
    """Delete everything this run wrote to the shared folder; call it when done."""
    _delete(spark, _run_folder(spark))


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside leave no shuffle files: they go when a job ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def seal(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond the files, so an iterative plan stays flat
    and a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with freeing_shuffles(spark):
        writer.parquet(path)
    table = spark.read.schema(_reordered(df, partition_by)).parquet(path).select(df.columns)
    table._sealed_at = path
    return table


def sealed(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` itself when it already is a sealed table, otherwise :func:`seal` of it."""
    return df if getattr(df, "_sealed_at", None) else seal(df, label)


def release(table: DataFrame) -> None:
    """Delete the files of a sealed table that nothing reads any more.

    Only tables written by :func:`seal` in this session are touched; anything else
    is left alone.
    """
    path = getattr(table, "_sealed_at", None)
    if path is None:
        return
    _delete(table.sparkSession, path)
    table._sealed_at = None


def part_of(table: DataFrame, condition: Column) -> DataFrame:
    """The rows of a sealed table that meet ``condition``: sealed as well, and released together with it."""
    part = table.where(condition)
    part._sealed_at = getattr(table, "_sealed_at", None)
    return part


def sealed_rows(table: DataFrame) -> int | None:
    """Row count of a sealed table (counted once); None for any other DataFrame."""
    if not getattr(table, "_sealed_at", None):
        return None
    if getattr(table, "_rows", None) is None:
        table._rows = table.count()
    return table._rows


def _reordered(df: DataFrame, partition_by: list[str] | None):
    """Schema of the written files: the partition columns come last."""
    tail = partition_by or []
    fields = [f for f in df.schema.fields if f.name not in tail]
    fields += [df.schema[name] for name in tail]
    schema = type(df.schema)(fields)
    return schema


def check_state_size(n_values: int, what: str, limit: int = MAX_STATE_BYTES) -> None:
    """Refuse to move more than ``limit`` bytes of model state through the driver."""
    if n_values * 8 > limit:
        raise ValueError(
            f"{what} holds {n_values} values, above the {limit // 8} allowed in a broadcast; "
            "only the sparse autoencoder and the sparse SVM have a weight-table form"
        )
