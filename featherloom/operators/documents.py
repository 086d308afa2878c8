"""Sparse documents: triples (doc, col, value), their grouping and their extent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.session import seal

# Separators of the text formats.
TAB = "\t"
WHITESPACE = "[ \\t\\n\\r]+"

#: Columns covered by one part of a grouped document.
PART_WIDTH = 4096

#: Texts whose words are held at once.
TEXTS_AT_ONCE = 256


def tokens(lines: DataFrame, text: str = "value", separator: str = TAB, keep: list[str] | None = None) -> DataFrame:
    """One row per token; the separator is a regular expression."""
    return lines.select(*(keep or []), F.explode(F.split(F.col(text), separator)).alias("word"))


def word_count(lines: DataFrame, text: str = "value", separator: str = TAB) -> DataFrame:
    """(word, n) over all lines; partial counts are combined before the shuffle."""
    return tokens(lines, text, separator).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _word_arrays(documents: DataFrame, doc: str, text: str, separator: str) -> DataFrame:
    """(doc, words): the (col, value) of each row, counted inside it."""
    kind = T.StructType([T.StructField("col", T.StringType()), T.StructField("value", T.DoubleType())])
    schema = T.StructType([T.StructField("doc", documents.schema[doc].dataType), T.StructField("words", T.ArrayType(kind))])

    def count(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                split = pc.split_pattern_regex(part.column(1), separator)
                words = pa.table({"row": pc.list_parent_indices(split), "col": pc.list_flatten(split)})
                words = words.filter(pc.not_equal(words["col"], ""))
                found = words.group_by(["row", "col"], use_threads=False).aggregate([([], "count_all")]).sort_by("row").combine_chunks()
                sizes = np.bincount(found["row"].to_numpy(), minlength=part.num_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                cols, values = (found[c].combine_chunks() for c in ("col", "count_all"))
                cells = pa.StructArray.from_arrays([cols.cast(pa.string()), values.cast(pa.float64())], names=["col", "value"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, cells)], names=["doc", "words"])

    return documents.select(doc, text).mapInArrow(count, schema)


def unrolled(rows: DataFrame, *keep: str) -> DataFrame:
    """(doc, ..., col, value) of (doc, words).

    The outer form with a condition behind it: one on ``words`` would be pushed below what is computed from them, and
    that would be computed twice.
    """
    return rows.select("doc", *keep, F.inline_outer("words")).where(F.col("col").isNotNull())


def term_rows(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", separator: str = WHITESPACE
) -> tuple[DataFrame, DataFrame | None]:
    """Word counts without a shuffle: (doc, words) of the ids that occur once, and (doc, col, value) of the others.

    An id that comes in several rows may hold any number of them, so its words are grouped as triples; None when
    there is no such id.  Only the ids are read to find out.
    """
    ids = documents.groupBy(F.col(doc).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = ids.where("_n > 1").select("_id")
    if repeated.isEmpty():
        return _word_arrays(documents, doc, text, separator), None
    repeated = seal(repeated, "repeated")
    match = documents[doc].eqNullSafe(repeated["_id"])
    cells = _word_arrays(documents.join(repeated, match, "left_semi"), doc, text, separator)
    return _word_arrays(documents.join(repeated, match, "left_anti"), doc, text, separator), sum_duplicates(unrolled(cells))


def term_triples(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", separator: str = WHITESPACE
) -> DataFrame:
    """(doc, col, value): how often each word occurs in each document.

    The word itself is the column key, so no vocabulary has to be numbered.
    """
    rows, others = term_rows(documents, doc, text, separator)
    triples = unrolled(rows)
    return triples if others is None else triples.unionByName(others)


def sum_duplicates(triples: DataFrame) -> DataFrame:
    """One row per (doc, col); repeated cells add up."""
    return triples.groupBy("doc", "col").agg(F.sum("value").alias("value"))


def group_documents(triples: DataFrame, part_width: int = PART_WIDTH) -> DataFrame:
    """(doc, part, words): words sorted by column, ``part_width`` columns per part.

    ``col`` is a non-negative integer.  A part covers a fixed range of columns and
    holds one word per column, so no array exceeds ``part_width`` entries however
    large a document is; reading parts in order gives the whole sorted document.
    """
    return (
        sum_duplicates(triples)
        .withColumn("part", F.floor(F.col("col") / part_width).cast("int"))
        .groupBy("doc", "part")
        .agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("words"))
    )


def ungroup_documents(parts: DataFrame) -> DataFrame:
    return parts.select("doc", F.inline("words"))


def drop_empty(parts: DataFrame, words: str = "words") -> DataFrame:
    return parts.where(F.size(words) > 0)


def sorted_by_document(parts: DataFrame) -> DataFrame:
    return parts.orderBy("doc", "part")


def matrix_extent(triples: DataFrame) -> DataFrame:
    """One row: largest document id, largest column id, number of entries; one pass."""
    return triples.agg(
        F.max("doc").alias("rows"), F.max("col").alias("cols"), F.count(F.lit(1)).alias("entries")
    )


def dataset_stats(triples: DataFrame) -> DataFrame:
    """One row: number of documents and largest column actually present."""
    per_doc = triples.groupBy("doc").agg(F.max("col").alias("top"))
    return per_doc.agg(F.count(F.lit(1)).alias("docs"), F.max("top").alias("cols"))


def feature_count(rows: DataFrame, indices: str = "indices") -> DataFrame:
    """One row: highest 0-based index plus one."""
    return rows.agg((F.max(F.array_max(indices)) + 1).alias("features"))


def sparse_vectors(parts: DataFrame, size: int, base: int = 1, keep_slot0: bool = False) -> DataFrame:
    """(doc, part, features): each part as an ml sparse vector of ``size`` slots.

    Indices of ``base`` 1 are shifted to 0; with ``keep_slot0`` they stay as they
    are and slot 0 remains empty (``size`` then counts it).
    """
    shift = 0 if keep_slot0 else base
    schema = T.StructType(
        [
            T.StructField("doc", parts.schema["doc"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("features", VectorUDT()),
        ]
    )

    def convert(batches):
        for batch in batches:
            words = batch.column(batch.schema.get_field_index("words"))
            flat = words.flatten()
            indices = pa.compute.subtract(flat.field("col").cast(pa.int32()), pa.scalar(shift, pa.int32()))
            n = batch.num_rows
            offsets = pa.array(words.offsets.to_numpy() - words.offsets.to_numpy()[0], pa.int32())
            vector = pa.StructArray.from_arrays(
                [
                    pa.array([0] * n, pa.int8()),
                    pa.array([size] * n, pa.int32()),
                    pa.ListArray.from_arrays(offsets, indices),
                    pa.ListArray.from_arrays(offsets, flat.field("value").cast(pa.float64())),
                ],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), vector], names=["doc", "part", "features"]
            )

    return parts.select("doc", "part", "words").mapInArrow(convert, schema)


def stored_cells(vectors: DataFrame) -> DataFrame:
    """(doc, slot, value) of sparse vectors, from the indices they store; nothing is made dense."""

    def cells(batches):
        for batch in batches:
            vector = batch.column(1)
            indices, values = vector.field("indices"), vector.field("values")
            owner = pa.array(indices.value_lengths().to_numpy())
            rows = pa.array([k for k, n in enumerate(owner.to_pylist()) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), indices.flatten().cast(pa.int64()), values.flatten()], names=["doc", "slot", "value"]
            )

    kind = vectors.schema["doc"].dataType.simpleString()
    return vectors.select("doc", "features").mapInArrow(cells, f"doc {kind}, slot long, value double")
