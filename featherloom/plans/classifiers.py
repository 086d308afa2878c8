"""Other classifiers on the same feature table, straight from ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The settings these classifiers are offered with.
BAYES_SMOOTHING = 0.01
TREE_DEPTH = 7
TREE_BINS = 64

CLASSIFIERS = {
    "naive_bayes": lambda: NaiveBayes(smoothing=BAYES_SMOOTHING),
    "decision_tree": lambda: DecisionTreeClassifier(impurity="gini", maxDepth=TREE_DEPTH, maxBins=TREE_BINS, seed=42),
    "logistic": lambda: LogisticRegression(maxIter=20),
}


def vector_rows(rows: DataFrame) -> DataFrame:
    """(id, label, features vector) from (id, label, features array)."""
    return rows.select(
        "id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("features")
    )


def fit_and_predict(name: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, label, predicted) of ``test``; naive Bayes needs non-negative features."""
    model = CLASSIFIERS[name]().fit(vector_rows(train))
    return model.transform(vector_rows(test)).select("id", "label", F.col("prediction").alias("predicted"))
