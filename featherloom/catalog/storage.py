"""Round trips through every text and vector format."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import CELLS, long_form, query, r6, table, vectors
from featherloom.catalog.vectors import MASKED_CELLS, masked
from featherloom.functions import vectors as V
from featherloom.plans import svm
from featherloom.session import scratch_path
from featherloom.sources import tables
from featherloom.sources import vectors as files

PER_LABEL = "round(sum(x), 4) + 0.0 AS total, count(*) AS cells"
BY_LABEL = f"WITH {CELLS} SELECT CAST(label AS DOUBLE) AS label, pos, {PER_LABEL} FROM cells GROUP BY label, pos"
BY_POS = f"WITH {CELLS} SELECT pos, {PER_LABEL} FROM cells GROUP BY pos"


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Per position (and key) the sum and count of all values."""
    cells = rows.select(*keys, F.posexplode("features").alias("pos", "x"))
    grouped = cells.groupBy(*keys, F.col("pos").cast("bigint").alias("pos"))
    return grouped.agg((F.round(F.sum("x"), 4) + 0.0).alias("total"), F.count(F.lit(1)).alias("cells"))


@query(
    f"""
WITH {MASKED_CELLS} SELECT CAST(label AS DOUBLE) AS label, pos, {PER_LABEL} FROM masked GROUP BY label, pos"""
)
def libsvm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "libsvm")
    files.write_libsvm(masked(spark, sf_dir), path)
    return sums(files.as_array(files.read_libsvm(spark, path, 64)), "label")


@query(BY_POS)
def dense_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    files.write_dense_csv(vectors(spark, sf_dir), path, "features", 64, header=True)
    return sums(files.read_dense_csv(spark, path, 64, header=True))


@query(BY_LABEL)
def labelled_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    files.write_labelled_text(vectors(spark, sf_dir), path)
    return sums(files.read_labelled_text(spark, path), "label")


@query(BY_LABEL)
def spaced_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "spaced")
    files.write_separated(vectors(spark, sf_dir), path, ["label"], "features", " ")
    return sums(files.read_spaced(spark, path), "label")


@query(f"WITH {CELLS} SELECT id, CAST(label AS DOUBLE) AS label, pos, round(x, 6) + 0.0 AS value FROM cells")
def tabbed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tabbed")
    files.write_separated(vectors(spark, sf_dir), path, ["id", "label"], "features", "\t")
    return long_form(files.read_tabbed(spark, path), "features", "id", "label")


@query(f"WITH {MASKED_CELLS} SELECT pos, {PER_LABEL} FROM masked WHERE x <> 0 GROUP BY pos")
def entries_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "entries")
    files.write_entries(masked(spark, sf_dir).select(V.to_entries("features").alias("entries")), path)
    cells = files.read_entries(spark, path).select(F.inline("entries"))
    grouped = cells.groupBy(F.col("idx").cast("bigint").alias("pos"))
    return grouped.agg((F.round(F.sum("val"), 4) + 0.0).alias("total"), F.count(F.lit(1)).alias("cells"))


@query(BY_POS)
def vector_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    files.write_vectors(vectors(spark, sf_dir), path)
    return sums(files.read_vectors(spark, path))


@query(BY_LABEL)
def labelled_points_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "points")
    files.write_labelled_points(vectors(spark, sf_dir), path)
    return sums(files.read_labelled_points(spark, path), "label")


@query("SELECT l_orderkey + 1 AS doc, l_partkey + 1 AS col, l_quantity AS value FROM lineitem")
def triples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "triples")
    cells = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("doc"), (F.col("l_partkey") + 1).alias("col"), F.col("l_quantity").alias("value")
    )
    tables.write_triples(cells, path)
    found = tables.read_triples(spark, path)
    return found.select(F.col("doc").cast("bigint").alias("doc"), F.col("col").cast("bigint").alias("col"), "value")


@query(
    """
WITH lines AS (SELECT conv_id, turn, role, count(*) OVER () AS n FROM conversations)
SELECT row_number() OVER (ORDER BY conv_id, turn, role) AS line, conv_id || '|' || turn || '|' || role AS value FROM lines"""
)
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    rows = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn", "role")
    rows.select(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")).write.text(path)
    return tables.numbered_lines(spark, path)


@query(
    f"""
WITH {CELLS} SELECT id, round(sum(x * ((pos % 9) - 4) / CAST(4 AS DOUBLE)) + CAST(0.25 AS DOUBLE), 6) + 0.0 AS margin
FROM cells GROUP BY id"""
)
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved and reloaded SVM without a threshold scores the vectors."""
    path = scratch_path(spark, "model")
    weights = np.array([(k % 9 - 4) / 4.0 for k in range(64)])
    svm.SvmModel(weights, 0.25, None).save(spark, path)
    scored = svm.SvmModel.load(spark, path).predict(vectors(spark, sf_dir))
    return scored.select("id", r6("predicted").alias("margin"))
