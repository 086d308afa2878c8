"""Losses, error rates, divergences and data-kind checks as aggregations."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.functions.vectors import squared_norm


def half_mean_squared_error(rows: DataFrame, error: str = "error") -> DataFrame:
    """One row: half the mean squared length of the error vectors."""
    return rows.agg((F.sum(squared_norm(error)) / F.count(F.lit(1)) * 0.5).alias("loss"))


def mean_vector(rows: DataFrame, column: str, output: str = "mean", keys: list[str] | None = None) -> DataFrame:
    """Element-wise mean of an array column, per key or over the whole table."""
    mean = Summarizer.mean(array_to_vector(F.col(column).cast("array<double>")))
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(mean.alias("_v")).select(*(keys or []), vector_to_array("_v").alias(output))


def running_mean(mean: float, old: float, gain: float = 0.01, decay: float = 0.09) -> float:
    """Running activation: gain * mean + decay * old."""
    return gain * mean + decay * old


def error_rate(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: share of mismatches among the scored rows, accuracy, row count."""
    wrong = F.avg((F.col(label) != F.col(predicted)).cast("double"))
    return rows.agg(
        wrong.alias("error_rate"), (1.0 - wrong).alias("accuracy"), F.count(F.lit(1)).alias("rows")
    )


def area_under_roc(rows: DataFrame, label: str = "label", score: str = "score") -> float:
    """Exact area under the ROC curve (no binning of the scores)."""
    evaluator = BinaryClassificationEvaluator(
        labelCol="_label", rawPredictionCol="_score", metricName="areaUnderROC", numBins=0
    )
    pairs = rows.select(F.col(label).cast("double").alias("_label"), F.col(score).cast("double").alias("_score"))
    return evaluator.evaluate(pairs)


def input_kind(rows: DataFrame, features: str) -> DataFrame:
    """One row: 'binary' if all values are 0/1, 'real01' if all lie in [0,1], else 'real'."""
    is_binary = F.bool_and(F.forall(features, lambda x: (x == 0.0) | (x == 1.0)))
    is_unit = F.bool_and(F.forall(features, lambda x: (x >= 0.0) & (x <= 1.0)))
    return rows.agg(F.when(is_binary, "binary").when(is_unit, "real01").otherwise("real").alias("kind"))


def illegal_labels(rows: DataFrame, label: str = "label", legal: tuple = (0, 1)) -> DataFrame:
    return rows.where(~F.col(label).isin(*legal))


def document_errors(pairs: DataFrame) -> DataFrame:
    """Per document of (doc, col, value, out): mean squared, summed squared and squared summed difference."""
    diff = F.col("out") - F.col("value")
    return pairs.groupBy("doc").agg(
        F.avg(diff * diff).alias("loss"),
        F.sum(diff * diff).alias("squared_error"),
        (F.sum(diff) * F.sum(diff)).alias("squared_sum"),
    )


def total_squared_error(pairs: DataFrame) -> DataFrame:
    diff = F.col("out") - F.col("value")
    return pairs.agg(F.sum(diff * diff).alias("squared_error"))


def aligned_difference(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc, col, difference) = output - input on the same cell.

    A cell present on one side only means the documents do not match and fails the job.
    """
    left = inputs.select("doc", "col", F.col("value").alias("_in"))
    right = outputs.select("doc", "col", F.col("value").alias("_out"))
    both = left.join(right, ["doc", "col"], "full")
    mismatch = F.raise_error(F.concat(F.lit("unmatched cell in document "), F.col("doc").cast("string")))
    return both.select(
        "doc",
        "col",
        F.when(F.col("_in").isNull() | F.col("_out").isNull(), mismatch.cast("double"))
        .otherwise(F.col("_out") - F.col("_in"))
        .alias("difference"),
    )


def divergences(p: DataFrame, q: DataFrame, key: str, weight: str) -> DataFrame:
    """One row: KL(p||q), KL(q||p) and their sum, for weights normalised to total 1.

    Keys with weight on one side only are ignored on the ``p ln p`` side where p is
    0 and make the divergence infinite (NULL) where q is 0.
    """
    ps = p.groupBy(key).agg(F.sum(weight).alias("p"))
    qs = q.groupBy(key).agg(F.sum(weight).alias("q"))
    p_total = ps.agg(F.sum("p")).scalar()
    q_total = qs.agg(F.sum("q")).scalar()
    joined = ps.join(qs, key, "full").select(
        (F.coalesce("p", F.lit(0.0)) / p_total).alias("p"), (F.coalesce("q", F.lit(0.0)) / q_total).alias("q")
    )

    def term(x: str, y: str):
        return F.when(F.col(x) == 0, 0.0).when(F.col(y) > 0, F.col(x) * F.ln(F.col(x) / F.col(y)))

    def divergence(x: str, y: str):
        impossible = F.bool_or((F.col(x) > 0) & (F.col(y) == 0))
        return F.when(~impossible, F.sum(term(x, y)))

    return joined.agg(divergence("p", "q").alias("kl_pq"), divergence("q", "p").alias("kl_qp")).select(
        "kl_pq", "kl_qp", (F.col("kl_pq") + F.col("kl_qp")).alias("symmetric_kl")
    )


def weight_penalty(weights: DataFrame, w: str = "w") -> DataFrame:
    """One row: sum of squared weights, and the plain sum kept as an option."""
    return weights.agg(F.sum(F.col(w) * F.col(w)).alias("squared"), F.sum(w).alias("raw"))
