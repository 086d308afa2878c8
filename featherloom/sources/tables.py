"""Text tables: triples, positional labels, plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIPLE_SCHEMA = "col BIGINT, doc BIGINT, value DOUBLE"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``col,doc,value`` (1-based); a malformed line fails the job."""
    return spark.read.schema(TRIPLE_SCHEMA).csv(path, mode="FAILFAST").select("doc", "col", "value")


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select("col", "doc", "value").write.csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): 1-based line numbers over the files in path order.

    Line positions come from the file name and the split's start byte, so they do
    not depend on how splits are packed into tasks.  The running offsets come from a
    table with one row per split.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    splits = raw.groupBy("file", "start").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(offsets, ["file", "start"]).select(
        (F.col("offset") + F.col("at") - F.col("first_at") + 1).alias("line"), "value"
    )


def read_labels(spark: SparkSession, path: str, shift: int = -1) -> DataFrame:
    """(doc, label): one integer per line, line n labels document n; 1/2 become 0/1."""
    return numbered_lines(spark, path).select(
        F.col("line").alias("doc"), (F.trim("value").cast("int") + shift).alias("label")
    )
