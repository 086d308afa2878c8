"""Linear SVM by distributed gradient descent on the hinge loss with an L2 penalty.

Step t uses step / sqrt(t): w <- w (1 - rate * reg) - rate * mean gradient.  Two
layouts share the rule: dense feature arrays with the weights on the driver, and
sparse triples with the weights as a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.functions.seeded import Draw, hashed
from featherloom.functions.vectors import margin
from featherloom.operators.joins import fits_broadcast, keep_keys
from featherloom.operators.splits import cell
from featherloom.plans import blocks, scoring
from featherloom.plans.settings import SvmSettings
from featherloom.plans.sparse_ae import Spread
from featherloom.session import check_state_size, part_of, release, seal, sealed, sealed_rows
from featherloom.sources.models import load_model, save_model


#: Weights that may stand in a plan as one constant.
LITERAL_WEIGHTS = 4096


def classify(score: Column, threshold: float | None) -> Column:
    """1.0 above the threshold, else 0.0; without a threshold the raw margin."""
    if threshold is None:
        return score
    return F.when(score > threshold, 1.0).otherwise(0.0)


def require_binary(label: str) -> Column:
    """The label, failing the job unless it is 0 or 1."""
    c = F.col(label).cast("double")
    return F.when(c.isin(0.0, 1.0), c).otherwise(
        F.raise_error(F.concat(F.lit("label is not 0 or 1: "), c.cast("string"))).cast("double")
    )


@dataclass
class SvmModel:
    weights: np.ndarray
    intercept: float = 0.0
    threshold: float | None = 0.0

    def set_threshold(self, threshold: float) -> SvmModel:
        return SvmModel(self.weights, self.intercept, threshold)

    def clear_threshold(self) -> SvmModel:
        return SvmModel(self.weights, self.intercept, None)

    def margin(self, features: str = "features") -> Column:
        """The margin as an expression; more than ``LITERAL_WEIGHTS`` weights are broadcast and kept out of the plan."""
        if len(self.weights) > LITERAL_WEIGHTS:
            return scoring.linear(SparkSession.active(), self.weights, self.intercept)(F.col(features).cast("array<double>"))
        # One constant, folded once; an array of literals would be a plan node per weight.
        weights = F.split(F.lit(" ".join(map(repr, self.weights.tolist()))), " ").cast("array<double>")
        return margin(weights, features, self.intercept)

    def predict(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` plus ``predicted``; a projection, also for streaming DataFrames."""
        return rows.withColumn("predicted", classify(self.margin(features), self.threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        about = {"threshold": self.threshold, "intercept": self.intercept, "classes": 2, "width": len(self.weights)}
        save_model(spark, path, "svm", [self.weights[None, :]], about)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SvmModel:
        matrices, about = load_model(spark, path, "svm")
        weights = matrices[0][0]
        if about["classes"] != 2 or about["width"] != len(weights):
            raise ValueError("stored SVM does not fit its description")
        return cls(weights, about["intercept"], about["threshold"])


def hinge_sums(rows: DataFrame, weights: np.ndarray, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """(name, unit, w): ``g`` is the summed hinge gradient, ``n`` row count and summed loss."""
    bound = rows.sparkSession.sparkContext.broadcast(weights)

    def contribute(batch):
        w = bound.value
        x = blocks.matrix(batch, "features")
        s = 2.0 * blocks.vector(batch, "label").astype(float) - 1.0
        if fraction < 1.0:
            taken = blocks.cell_draws(blocks.vector(batch, "id"), 1, seed)[:, 0] < fraction
            x, s = x[taken], s[taken]
        gap = 1.0 - s * (x @ w)
        active = gap > 0
        return {"g": -(s[active, None] * x[active]).sum(axis=0), "n": np.array([len(x), gap[active].sum()])}

    ready = rows.select("id", require_binary("label").alias("label"), "features")
    return blocks.sum_over_rows(ready, contribute)


def train(
    rows: DataFrame,
    settings: SvmSettings = SvmSettings(),
    initial: np.ndarray | None = None,
    intercept: bool = False,
) -> SvmModel:
    """Rows are (id, label 0/1, features array).

    With ``intercept`` a constant feature is added in last place and its weight
    becomes the intercept.
    """
    data = rows.select("id", "label", F.col("features").cast("array<double>").alias("features"))
    if intercept:
        data = data.withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    # Every step reads the rows again; written once, none runs the caller's plan again.
    data = seal(data, "svm-rows")
    first = data.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows to train on")
    width = first[0]
    check_state_size(width, "the SVM")
    w = np.zeros(width)
    if initial is not None:
        w[: len(initial)] = initial
    for t in range(1, settings.iterations + 1):
        sums = blocks.collect_sums(hinge_sums(data, w, settings.fraction, settings.seed + t))
        n = sums["n"][0][0] if "n" in sums else 0
        if n == 0:
            continue
        rate = settings.step / np.sqrt(t)
        new = w * (1.0 - rate * settings.reg) - rate * sums["g"][0] / n
        done = t > 1 and np.linalg.norm(new - w) < settings.tolerance * max(np.linalg.norm(new), 1.0)
        w = new
        if done:
            break
    release(data)
    if intercept:
        return SvmModel(w[:-1], float(w[-1]))
    return SvmModel(w)


# Sparse layout: triples (doc, col, value), labels (doc, label), weights (col, w).


def sparse_margins(spread: Spread, weights: DataFrame) -> DataFrame:
    """(doc, margin) of every document."""
    joined = spread.with_weights(weights, 1, "w")
    return joined.groupBy("doc").agg(F.sum(F.col("value") * F.col("w")).alias("margin"))


def sparse_step(
    spread: Spread, labels: DataFrame, weights: DataFrame, rate: float, reg: float
) -> tuple[DataFrame, DataFrame]:
    """(col, w, old) after one step over all labelled documents, and the table it reads.

    The pull of each document on its words, -sign inside the margin and 0 outside,
    is written out: the gradient and the document count both need it.  Documents without a
    pull add nothing; the others are broadcast where they fit, and no cell moves for them.
    """
    sign = 2.0 * require_binary("label") - 1.0
    scored = labels.join(sparse_margins(spread, weights), "doc")
    pull = seal(scored.select("doc", F.when(sign * F.col("margin") < 1.0, -sign).otherwise(0.0).alias("pull")), "pull")
    n = max(sealed_rows(pull), 1)
    active = part_of(pull, F.col("pull") != 0)
    small = fits_broadcast(active, 1)
    cells = spread.rows.join(F.broadcast(active), "doc") if small else spread.with_documents(spread.rows, active)
    gradient = cells.groupBy("col").agg((F.sum(F.col("pull") * F.col("value"))).alias("g"))
    shrunk = F.col("w") * (1.0 - rate * reg)
    moved = weights.join(gradient, "col", "left").select(
        "col", (shrunk - rate * F.coalesce("g", F.lit(0.0)) / F.lit(float(n))).alias("w"), F.col("w").alias("old")
    )
    return moved, pull


def zero_weights(triples: DataFrame) -> DataFrame:
    return triples.select("col").distinct().withColumn("w", F.lit(0.0))


def train_sparse(triples: DataFrame, labels: DataFrame, settings: SvmSettings, draw: Draw | None = None) -> DataFrame:
    """Weight table (col, w, moved) after ``settings.iterations`` steps.

    ``moved`` is the squared change of the last step.  With ``fraction`` below 1 a step takes the documents whose number
    (``draw``, by default a hash with the seed) lies in a window of that width; windows follow one another around [0, 1),
    so every document has its turn before any has its next.  Triples are written in ranges of that number, and a step
    reads the row groups of its window.
    """
    sampled = settings.fraction < 1.0
    place = cell(draw or hashed(settings.seed), "doc")
    known = labels.select("doc", "label")
    known = seal(known.withColumn("_u", place) if sampled else known, "labels")
    kept = keep_keys(sealed(triples, "triples"), known, "doc", ["col"])
    if sampled:
        tasks = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        ranged = kept.withColumn("_u", place).repartitionByRange(tasks, "_u", "doc", F.xxhash64("col"))
        kept = seal(ranged.sortWithinPartitions("_u"), "triples")
    spread = Spread.of(kept)
    weights = seal(zero_weights(spread.rows), "svm")
    for t in range(1, settings.iterations + 1):
        rate = settings.step / float(np.sqrt(t))
        part, drawn = spread, known
        if sampled:
            inside = window(t, settings.fraction)
            part, drawn = spread.where(inside), known.where(inside).drop("_u")
        moved, pull = sparse_step(part, drawn, weights, rate, settings.reg)
        both = seal(moved.select("col", "w", ((F.col("w") - F.col("old")) ** 2).alias("moved")), "svm")
        change, size = both.agg(F.sqrt(F.sum("moved")), F.sqrt(F.sum(F.col("w") ** 2))).first()
        release(weights)
        release(pull)
        weights = both
        if t > 1 and change < settings.tolerance * max(size, 1.0):
            break
    return weights


def window_bounds(t: int, fraction: float) -> tuple[float, float]:
    """Where the window of step ``t`` begins in [0, 1) and where it ends (above 1: it goes on from 0)."""
    low = ((t - 1) * fraction) % 1.0
    return low, low + fraction


def window(t: int, fraction: float) -> Column:
    low, high = window_bounds(t, fraction)
    u = F.col("_u")
    return (u >= low) & (u < high) if high <= 1.0 else (u >= low) | (u < high - 1.0)


def predict_sparse(triples: DataFrame, weights: DataFrame, threshold: float | None = 0.0) -> DataFrame:
    """(doc, margin, predicted); words without a weight count as 0."""
    spread = Spread.of(triples)
    joined = spread.with_weights(weights, 1, "w", how="left", by_doc=False)
    margins = joined.groupBy("doc").agg(F.sum(F.col("value") * F.coalesce("w", F.lit(0.0))).alias("margin"))
    return margins.withColumn("predicted", classify(F.col("margin"), threshold))

