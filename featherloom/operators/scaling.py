"""Normalisation of sparse documents and of vector columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.functions.vectors import doubles
from featherloom.operators.documents import unrolled
from featherloom.operators.joins import find_hot
from featherloom.session import seal

# Fixed value: largest argument whose exponential still fits a double.
EXP_LIMIT = 709.0


def document_softmax(triples: DataFrame, stable: bool = False) -> DataFrame:
    """value -> e^value / sum of e^value over the words present in the document.

    A document with any value above ``EXP_LIMIT``, or whose sum of exponentials is no longer
    finite, becomes empty and disappears; :func:`left_out` counts those.  ``stable`` shifts by the
    document's maximum instead, so none is lost; pipelines use that form.

    Documents that are one row each, (doc, words), are normalised where they lie.  For triples
    equal values of a document are counted first, which leaves a few rows of it to find its
    denominator from; denominators are written out and joined back with hot documents split.  A
    window over the document would put all its words in one task.
    """
    if "words" in triples.columns:
        return _softmax_of_rows(triples, stable)
    n = F.count(F.lit(1)).alias("n")
    alike = triples.groupBy("doc", "value").agg(n)
    top = F.max("value").alias("top")
    if stable:
        alike = seal(alike, "values")
        alike = alike.join(alike.groupBy("doc").agg(top), "doc")
    shift = F.col("top") if stable else F.lit(0.0)
    sums = alike.groupBy("doc").agg(
        F.sum(F.col("n") * F.exp(F.col("value") - shift)).alias("denominator"), top, F.sum("n").alias("n")
    )
    sums = seal(sums, "sums")
    hot = find_hot(sums, "doc")
    if not stable:
        sums = sums.where(_representable())
    joined = hot.join(triples, sums.drop("n"), ["col"])
    return joined.select("doc", "col", _softmaxed(stable))


def _softmaxed(stable: bool):
    shift = F.col("top") if stable else F.lit(0.0)
    return (F.exp(F.col("value") - shift) / F.col("denominator")).alias("value")


def _softmax_of_rows(rows: DataFrame, stable: bool) -> DataFrame:
    """(doc, col, value) softmaxed from (doc, words), without a shuffle; as in the joins of triples, an id is not null."""
    found = rows.where(F.col("doc").isNotNull()).select("doc", "words", F.array_max(F.transform("words", lambda w: w["value"])).alias("top"))
    shift = F.col("top") if stable else F.lit(0.0)
    total = F.aggregate("words", F.lit(0.0), lambda s, w: s + F.exp(w["value"] - shift))
    found = found.select("doc", "words", "top", total.alias("denominator"))
    if not stable:
        found = found.withColumn("words", F.when(_representable(), F.col("words")))
    return unrolled(found, "top", "denominator").select("doc", "col", _softmaxed(stable))


def softmaxed_terms(rows: DataFrame, others: DataFrame | None, stable: bool = False) -> DataFrame:
    """:func:`document_softmax` of what ``documents.term_rows`` returns."""
    found = document_softmax(rows, stable)
    return found if others is None else found.unionByName(document_softmax(seal(others, "terms"), stable))


def _representable():
    """True for documents (top, denominator) whose exponentials and their sum fit a double."""
    return (F.col("top") <= EXP_LIMIT) & (F.col("denominator") < F.lit(float("inf")))


def left_out(triples: DataFrame) -> DataFrame:
    """One row (documents, left_out): how many documents the literal softmax can't express."""
    sums = triples.groupBy("doc").agg(F.sum(F.exp("value")).alias("denominator"), F.max("value").alias("top"))
    return sums.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~_representable()).alias("left_out"))


def column_extent(rows: DataFrame, features: str) -> DataFrame:
    """One row (lo, hi): per-position minimum and maximum as arrays."""
    summary = rows.agg(
        Summarizer.metrics("min", "max").summary(array_to_vector(doubles(features))).alias("s")
    )
    return summary.select(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))


def column_minmax(rows: DataFrame, features: str, output: str) -> DataFrame:
    """Each position scaled to [0, 1] over the whole table; constant positions give NULL.

    The extent is one row, attached as a scalar subquery.  Label and features are
    scaled together by passing them as one array.
    """
    extent = column_extent(rows, features).select(F.struct("lo", "hi")).scalar()
    scaled = F.zip_with(
        F.zip_with(doubles(features), F.col("_extent.lo"), lambda x, lo: x - lo),
        F.zip_with(F.col("_extent.hi"), F.col("_extent.lo"), lambda hi, lo: F.nullif(hi - lo, F.lit(0.0))),
        lambda offset, width: offset / width,
    )
    return rows.withColumn("_extent", extent).withColumn(output, scaled).drop("_extent")
