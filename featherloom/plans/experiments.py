"""End-to-end experiments: documents to features to classifier to accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.functions.activations import sigmoid_all
from featherloom.functions.seeded import Draw, hashed
from featherloom.operators.joins import keep_keys
from featherloom.operators.metrics import error_rate
from featherloom.operators.scaling import document_softmax
from featherloom.operators.splits import random_split
from featherloom.plans import sparse_ae, svm
from featherloom.plans.settings import SparseAutoencoderSettings, SvmSettings
from featherloom.session import seal, sealed


def encoded_accuracy(
    triples: DataFrame,
    labels: DataFrame,
    encoder: SparseAutoencoderSettings,
    classifier: SvmSettings,
    weights: tuple[float, float] = (0.9, 0.1),
    seed: int = 43,
) -> DataFrame:
    """Softmaxed words -> sparse autoencoder -> SVM; error rate of the held-out documents.

    The encoder learns from the training documents only; the held-out ones are
    encoded by the trained model.
    """
    train_labels, test_labels = random_split(labels, "doc", list(weights), hashed(seed))
    triples = sealed(triples, "terms")
    counts = seal(keep_keys(triples, labels, "doc", ["col"]), "terms")
    words = seal(document_softmax(counts, stable=True), "words")
    train_words = keep_keys(words, train_labels, "doc", ["col"])
    model = sparse_ae.train(train_words, encoder)
    # From the labels: a document without words has the code of an empty row.
    empty = F.array(*[F.lit(float(b)) for b in model.hidden_bias])
    known = labels.join(model.encode(words), "doc", "left")
    encoded = seal(known.withColumn("hidden", F.coalesce("hidden", sigmoid_all(empty))), "encoded")
    as_rows = encoded.select(F.col("doc").alias("id"), "label", F.col("hidden").alias("features"))
    classifier_model = svm.train(as_rows.join(train_labels.select(F.col("doc").alias("id")), "id", "left_semi"), classifier)
    held_out = as_rows.join(test_labels.select(F.col("doc").alias("id")), "id", "left_semi")
    return error_rate(classifier_model.predict(held_out))


def words_accuracy(
    triples: DataFrame,
    labels: DataFrame,
    classifier: SvmSettings,
    softmaxed: bool = True,
    weights: tuple[float, float] = (0.9, 0.1),
    seed: int = 43,
    draw: Draw | None = None,
) -> DataFrame:
    """Words, softmaxed or raw, straight into the SVM; error rate of the held-out documents."""
    scored = words_margins(triples, labels, classifier, softmaxed, weights, seed, draw)
    return error_rate(scored.withColumn("predicted", svm.classify(F.col("margin"), 0.0)))


def words_margins(
    triples: DataFrame,
    labels: DataFrame,
    classifier: SvmSettings,
    softmaxed: bool = True,
    weights: tuple[float, float] = (0.9, 0.1),
    seed: int = 43,
    draw: Draw | None = None,
) -> DataFrame:
    """(doc, label, margin) of the held-out documents under an SVM of the others' words.

    ``draw`` deals the documents to the two parts (default: hashes with ``seed``).
    """
    train_labels, test_labels = random_split(labels, "doc", list(weights), draw or hashed(seed))
    words = seal(keep_keys(sealed(triples, "terms"), labels, "doc", ["col"]), "terms")
    if softmaxed:
        words = seal(document_softmax(words, stable=True), "words")
    # The training documents are chosen there, once.
    learned = svm.train_sparse(words, train_labels, classifier)
    held_out = keep_keys(words, test_labels, "doc", ["col"])
    # From the labels: a document without words has margin 0.
    scored = test_labels.join(svm.predict_sparse(held_out, learned, None), "doc", "left")
    return scored.select("doc", "label", F.coalesce("margin", F.lit(0.0)).alias("margin"))
