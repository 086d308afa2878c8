import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featherloom.plans import classifiers, experiments, feedforward, svm
from featherloom.plans.estimator import Autoencoder, AutoencoderModel, minimise
from featherloom.plans.settings import NetworkSettings, SparseAutoencoderSettings, SvmSettings
from featherloom.session import scratch_path
from featherloom.streaming import scoring


def vector_rows(spark, n=60):
    gen = np.random.default_rng(0)
    base = gen.random((n, 2))
    x = np.hstack([base, base, 1 - base])
    rows = spark.createDataFrame([(k, x[k].tolist()) for k in range(n)], "id BIGINT, a ARRAY<DOUBLE>")
    return rows.select("id", array_to_vector("a").alias("x"))


def test_autoencoder_estimator(spark):
    rows = vector_rows(spark)
    estimator = Autoencoder(layers=[6, 2, 6], inputCol="x", outputCol="code", maxIter=6)
    encoder, decoder = estimator.fit_pair(rows)
    assert encoder.history[-1] < encoder.history[0] and encoder.kind == "real01"
    coded = encoder.transform(rows)
    assert coded.first()["code"].size == 2
    back = decoder.setInputCol("code").setOutputCol("again").transform(coded)
    assert back.first()["again"].size == 6
    path = scratch_path(spark, "ae")
    encoder.save(spark, path)
    again = AutoencoderModel.load(spark, path).transform(rows)
    assert again.orderBy("id").first()["code"].toArray() == pytest.approx(coded.orderBy("id").first()["code"].toArray())
    in_chain = Pipeline(stages=[estimator.setMaxIter(1)]).fit(rows)
    assert "code" in in_chain.transform(rows).columns


def test_autoencoder_checks_its_columns(spark):
    rows = vector_rows(spark, 5)
    with pytest.raises(ValueError, match="already exists"):
        Autoencoder(layers=[6, 2, 6], inputCol="x", outputCol="id").fit(rows)
    with pytest.raises(ValueError, match="vector column"):
        Autoencoder(layers=[6, 2, 6], inputCol="id", outputCol="code").fit(rows)
    with pytest.raises(ValueError, match="layers"):
        Autoencoder(layers=[6, 2, 5], inputCol="x", outputCol="code").fit(rows)


def test_minimiser_finds_the_minimum_of_a_quadratic():
    centre, scales = np.array([1.0, -2.0, 3.0]), np.array([1.0, 10.0, 100.0])

    def objective(p):
        return float((scales * (p - centre) ** 2).sum()), 2 * scales * (p - centre)

    found, history = minimise(objective, np.zeros(3), 100, 1e-14)
    assert found == pytest.approx(centre, abs=1e-4) and history[-1] < history[0]


def test_streaming_scores_equal_batch_scores(spark):
    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    gen = np.random.default_rng(4)
    rows = spark.createDataFrame(
        [(k, [0.0], gen.random(3).tolist()) for k in range(40)], "id BIGINT, label ARRAY<DOUBLE>, features ARRAY<DOUBLE>"
    )
    rows.repartition(4).write.parquet(source)
    settings = NetworkSettings(sizes=(3, 4, 1))
    weights = feedforward.initial_weights(settings)
    line = svm.SvmModel(np.array([1.0, -1.0, 0.5]))

    def score(df):
        return line.predict(feedforward.score(df, weights, settings).withColumnRenamed("predicted", "network"))

    stream = scoring.vector_stream(spark, source, rows.schema, files_per_trigger=2)
    assert stream.isStreaming
    progress = scratch_path(spark, "progress")
    scoring.score_to_files(stream, score, target, progress).awaitTermination()
    streamed = {r["id"]: (r["network"][0], r["predicted"]) for r in spark.read.parquet(target).collect()}
    batch = {r["id"]: (r["network"][0], r["predicted"]) for r in score(rows).collect()}
    assert streamed.keys() == batch.keys()
    assert all(streamed[k] == pytest.approx(batch[k]) for k in batch)
    # A second run with the same folder writes what has come since, and nothing twice.
    rows.limit(3).withColumn("id", F.col("id") + 1000).write.mode("append").parquet(source)
    scoring.score_to_files(scoring.vector_stream(spark, source, rows.schema), score, target, progress).awaitTermination()
    again = [r["id"] for r in spark.read.parquet(target).collect()]
    assert len(again) == len(set(again)) == 43


def word_documents(spark):
    """Documents about one of two word groups; the label follows the group."""
    cells, labels = [], []
    for doc in range(60):
        side = doc % 2
        labels.append((doc, side))
        cells += [(doc, f"w{side}{(doc + k) % 6}", 1.0 + k % 2) for k in range(4)] + [(doc, "common", 1.0)]
    return (
        spark.createDataFrame(cells, "doc BIGINT, col STRING, value DOUBLE"),
        spark.createDataFrame(labels, "doc BIGINT, label INT"),
    )


def test_words_to_svm_separates_the_groups(spark):
    triples, labels = word_documents(spark)
    found = experiments.words_accuracy(triples, labels, SvmSettings(iterations=5), weights=(0.6, 0.4)).first()
    assert found["accuracy"] > 0.9 and 10 < found["rows"] < 40
    raw = experiments.words_accuracy(triples, labels, SvmSettings(iterations=5), softmaxed=False, weights=(0.6, 0.4))
    assert raw.first()["accuracy"] > 0.9


def test_encoded_words_to_svm_runs_end_to_end(spark):
    triples, labels = word_documents(spark)
    encoder = SparseAutoencoderSettings(hidden=3, iterations=1, decay_in=0.0, decay_out=0.0)
    found = experiments.encoded_accuracy(triples, labels, encoder, SvmSettings(iterations=3), weights=(0.6, 0.4)).first()
    assert 0.0 <= found["error_rate"] <= 1.0 and 10 < found["rows"] < 40


def test_other_classifiers(spark):
    rows = spark.range(60).select(
        "id", (F.col("id") % 2).alias("label"), F.array(F.col("id") % 2, (F.col("id") * 7) % 5).cast("array<double>").alias("features")
    )
    for name in classifiers.CLASSIFIERS:
        found = classifiers.fit_and_predict(name, rows, rows)
        assert found.where(F.col("label") == F.col("predicted")).count() > 45, name
