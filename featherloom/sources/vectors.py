"""Vector tables in LIBSVM, CSV, TSV and labelled text formats."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.functions.vectors import to_entries


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """label, features; ``features`` fixes the width, otherwise it is inferred.

    Indices must ascend strictly; blank lines and ``#`` lines are skipped.
    """
    reader = spark.read.format("libsvm")
    if features is not None and features > 0:
        reader = reader.option("numFeatures", str(features))
    return reader.load(path)


def write_libsvm(rows: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Active entries only, 1-based: the non-zero ones of arrays, the stored ones of vectors."""
    y = F.col(label).cast("double")
    if not dict(rows.dtypes)[features].startswith("array"):
        rows.select(y.alias("label"), F.col(features).alias("features")).write.format("libsvm").save(path)
        return
    entries = F.transform(
        to_entries(features, base=1), lambda e: F.concat_ws(":", e["idx"].cast("string"), e["val"].cast("string"))
    )
    rows.select(F.concat_ws(" ", y.cast("string"), F.concat_ws(" ", entries)).alias("value")).write.text(path)


def usable_lines(lines: DataFrame) -> DataFrame:
    """Without blank lines and lines that start with ``#``."""
    trimmed = lines.select(F.trim("value").alias("value"))
    return trimmed.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def _numbers(text: Column, separator: str) -> Column:
    return F.transform(F.split(F.trim(text), separator), lambda t: t.cast("double"))


def _entries(text: Column, separator: str, base: int) -> Column:
    """``i:v`` items as array<struct<idx,val>> shifted to 0-based; blank text gives an empty array."""
    items = F.filter(F.split(F.trim(text), separator), lambda t: t != "")
    return F.transform(
        items,
        lambda t: F.struct(
            (F.split_part(t, F.lit(":"), F.lit(1)).cast("int") - base).alias("idx"),
            F.split_part(t, F.lit(":"), F.lit(2)).cast("double").alias("val"),
        ),
    )


def read_entries(spark: SparkSession, path: str, base: int = 1, keep_empty: bool = False) -> DataFrame:
    """Unlabelled ``i:v i:v`` rows without ``#`` lines; a blank line is an empty vector, dropped by default."""
    lines = spark.read.text(path)
    lines = lines.where(~F.ltrim("value").startswith("#")) if keep_empty else usable_lines(lines)
    rows = lines.select(_entries(F.col("value"), " +", base).alias("entries"))
    return rows if keep_empty else rows.where(F.size("entries") > 0)


def write_entries(rows: DataFrame, path: str, entries: str = "entries", base: int = 1) -> None:
    items = F.transform(
        entries, lambda e: F.concat_ws(":", (e["idx"] + base).cast("string"), e["val"].cast("string"))
    )
    rows.select(F.concat_ws(" ", items).alias("value")).write.text(path)


def read_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``L,f1 f2 ...``; blank and ``#`` lines are skipped, as in the readers below."""
    return usable_lines(spark.read.text(path)).select(
        F.split_part("value", F.lit(","), F.lit(1)).cast("double").alias("label"),
        _numbers(F.split_part("value", F.lit(","), F.lit(2)), " +").alias("features"),
    )


def write_labelled_text(rows: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    numbers = F.concat_ws(" ", F.transform(F.col(features), lambda x: x.cast("string")))
    rows.select(F.concat_ws(",", F.col(label).cast("double").cast("string"), numbers).alias("value")).write.text(path)


def read_spaced(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``label f1 f2 ...`` separated by spaces."""
    numbers = usable_lines(spark.read.text(path)).select(_numbers(F.col("value"), " +").alias("n"))
    return numbers.select(
        F.element_at("n", 1).alias("label"), F.slice("n", F.lit(2), F.size("n") - 1).alias("features")
    )


def read_tabbed(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id y x1 ... xn`` separated by tabs; the id is read as an integer, never through a double."""
    numbers = usable_lines(spark.read.text(path)).select(
        F.trim(F.get(F.split(F.trim("value"), "\t"), F.lit(0))).cast("bigint").alias("id"), _numbers(F.col("value"), "\t").alias("n")
    )
    return numbers.select(
        "id",
        F.element_at("n", 2).alias("label"),
        F.slice("n", F.lit(3), F.size("n") - 2).alias("features"),
    )


def write_separated(rows: DataFrame, path: str, scalars: list[str], features: str, separator: str) -> None:
    """Scalar columns, then the vector's values, joined by ``separator``."""
    head = [F.col(c).cast("string") for c in scalars]
    numbers = F.transform(F.col(features), lambda x: x.cast("string"))
    rows.select(F.concat_ws(separator, *head, F.concat_ws(separator, numbers)).alias("value")).write.text(path)


def read_dense_csv(
    spark: SparkSession, path: str, width: int, header: bool = False, drop_last: bool = False
) -> DataFrame:
    """CSV of doubles as one array column; ``drop_last`` leaves the last column out."""
    names = [f"c{k}" for k in range(width)]
    table = spark.read.schema(", ".join(f"{n} DOUBLE" for n in names)).csv(path, header=header, mode="FAILFAST")
    kept = names[:-1] if drop_last else names
    return table.select(F.array(*kept).alias("features"))


def write_dense_csv(rows: DataFrame, path: str, features: str, width: int, header: bool = False) -> None:
    rows.select(*[F.col(features)[k].alias(f"c{k}") for k in range(width)]).write.csv(path, header=header)


def _parse_vector(text: Column) -> Column:
    """``[1.0,2.0]`` or ``(n,[i],[v])`` as a dense array of doubles."""
    inner = F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1)
    dense = F.transform(F.filter(F.split(inner, ","), lambda t: F.trim(t) != ""), lambda t: t.cast("double"))
    part = r"^\s*\(\s*(\d+)\s*,\s*\[([^\]]*)\]\s*,\s*\[([^\]]*)\]\s*\)\s*$"
    size = F.regexp_extract(text, part, 1).cast("int")
    as_list = lambda group: F.filter(
        F.split(F.regexp_extract(text, part, group), ","), lambda t: F.trim(t) != ""
    )
    lookup = F.map_from_arrays(
        F.transform(as_list(2), lambda t: t.cast("int")), F.transform(as_list(3), lambda t: t.cast("double"))
    )
    sparse = F.element_at(
        F.transform(
            F.array(lookup),
            lambda m: F.transform(
                F.sequence(F.lit(0), size - 1), lambda k: F.coalesce(F.element_at(m, k), F.lit(0.0))
            ),
        ),
        1,
    )
    # sequence(0, -1) would count down: a vector without slots has none.
    empty = F.array().cast("array<double>")
    return F.when(F.trim(text).startswith("["), dense).when(size == 0, empty).otherwise(sparse)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One vector per line, in the text form of ml vectors."""
    return spark.read.text(path).select(_parse_vector(F.col("value")).alias("features"))


def write_vectors(rows: DataFrame, path: str, features: str = "features") -> None:
    rows.select(
        F.concat(F.lit("["), F.concat_ws(",", F.transform(F.col(features), lambda x: x.cast("string"))), F.lit("]")).alias(
            "value"
        )
    ).write.text(path)


def read_labelled_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(label,vector)`` in the text form of labelled points."""
    text = F.regexp_extract("value", r"^\s*\(\s*([^,]+),(.*)\)\s*$", 2)
    label = F.regexp_extract("value", r"^\s*\(\s*([^,]+),(.*)\)\s*$", 1).cast("double")
    return spark.read.text(path).select(label.alias("label"), _parse_vector(text).alias("features"))


def write_labelled_points(rows: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    numbers = F.concat_ws(",", F.transform(F.col(features), lambda x: x.cast("string")))
    rows.select(
        F.concat(F.lit("("), F.col(label).cast("double").cast("string"), F.lit(",["), numbers, F.lit("])")).alias("value")
    ).write.text(path)


def as_array(rows: DataFrame, features: str = "features") -> DataFrame:
    """ml vector column to array<double>."""
    return rows.withColumn(features, vector_to_array(features))
