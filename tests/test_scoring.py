"""Models as expressions, sampled descent on sparse documents, readers that skip comments."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from featherloom.functions import seeded
from featherloom.plans import feedforward, scoring, svm
from featherloom.plans.estimator import AutoencoderModel
from featherloom.plans.settings import NetworkSettings, SvmSettings
from featherloom.session import scratch_path
from featherloom.sources import vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_margins_are_an_expression_with_filters_below(spark):
    width = 5000
    gen = np.random.default_rng(2)
    model = svm.SvmModel(gen.normal(size=width), 0.25)
    x = gen.normal(size=(6, width))
    rows = spark.createDataFrame([(k, "kept", v.tolist()) for k, v in enumerate(x)] + [(6, "kept", None)], "id BIGINT, extra STRING, features ARRAY<DOUBLE>")
    path = scratch_path(spark, "rows")
    rows.write.parquet(path)
    scored = model.clear_threshold().predict(spark.read.parquet(path)).where("id > 2").select("id", "predicted")
    text = plan(scored)
    assert text.index("ArrowEvalPython") < text.index("Filter") and "ReadSchema: struct<id:bigint,features:array<double>>" in text
    assert len(text) < 5000
    found = {r["id"]: r["predicted"] for r in scored.collect()}
    assert found[6] is None and len(found) == 4
    for k in range(3, 6):
        assert found[k] == pytest.approx(x[k] @ model.weights + 0.25)


def test_networks_in_sql_text_and_null_vectors(spark):
    settings = NetworkSettings(sizes=(3, 2, 2), output="sigm")
    weights = feedforward.initial_weights(settings)
    spark.udf.register("encoded", scoring.network(spark, weights, settings))
    spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, None), (3, [0.5, 0.1, 0.9])], "id BIGINT, x ARRAY<DOUBLE>").createOrReplaceTempView("rows_to_encode")
    found = {r["id"]: r["y"] for r in spark.sql("SELECT id, encoded(x) AS y FROM rows_to_encode").collect()}
    want = feedforward.forward_block(np.array([[0.1, 0.2, 0.3], [0.5, 0.1, 0.9]]), weights, settings).output
    assert found[2] is None and found[1] == pytest.approx(want[0].tolist()) and found[3] == pytest.approx(want[1].tolist())
    only_null = spark.sql("SELECT encoded(x) AS y FROM rows_to_encode WHERE id = 2").collect()
    assert only_null[0]["y"] is None


def test_the_estimators_model_prunes_and_filters(spark):
    weights = [np.full((2, 4), 0.1), ]
    model = AutoencoderModel([3, 2], weights, inputCol="x", outputCol="code")
    rows = spark.createDataFrame([(k, "y", [0.1 * k, 0.2, 0.3]) for k in range(5)], "id BIGINT, other STRING, a ARRAY<DOUBLE>")
    path = scratch_path(spark, "rows")
    rows.write.parquet(path)
    ready = spark.read.parquet(path).withColumn("x", array_to_vector("a"))
    found = model.transform(ready).where("id = 4").select("id", vector_to_array("code").alias("code"))
    assert "other" not in plan(found) and "PushedFilters: [IsNotNull(id), EqualTo(id,4)]" in plan(found)
    z = 0.1 * (1 + 0.4 + 0.2 + 0.3)
    assert found.first()["code"] == pytest.approx([1 / (1 + np.exp(-z))] * 2)


@pytest.mark.parametrize("fraction", [0.4, 0.5])
def test_sampled_steps_take_the_documents_of_their_window(spark, fraction):
    gen = np.random.default_rng(4)
    x = gen.uniform(size=(50, 8)) * (gen.uniform(size=(50, 8)) < 0.5)
    y = (gen.uniform(size=50) < 0.5).astype(int)
    triples = spark.createDataFrame([(d, f"c{c}", float(v)) for d, own in enumerate(x) for c, v in enumerate(own) if v], "doc BIGINT, col STRING, value DOUBLE")
    labels = spark.createDataFrame([(d, int(s)) for d, s in enumerate(y)], "doc BIGINT, label INT")
    draw = seeded.modular(3)
    u = np.array([r["u"] for r in labels.orderBy("doc").select(draw(F.col("doc"), F.lit(0)).alias("u")).collect()])
    settings = SvmSettings(iterations=4, fraction=fraction, tolerance=0.0)
    found = {r["col"]: r["w"] for r in svm.train_sparse(triples, labels, settings, draw).collect()}
    w = np.zeros(8)
    there, seen = x.any(axis=1), np.zeros(50, int)
    for t in range(1, 5):
        low, high = svm.window_bounds(t, fraction)
        inside = ((u >= low) & (u < high)) | (u < high - 1.0)
        seen += inside
        own = inside & there
        s = 2.0 * y[own] - 1.0
        g = -(s * (s * (x[own] @ w) < 1))[:, None] * x[own]
        w = w * (1 - 0.01 / np.sqrt(t)) - g.sum(axis=0) / max(own.sum(), 1) / np.sqrt(t)
    assert [found[f"c{c}"] for c in range(8)] == pytest.approx(w.tolist(), abs=1e-12)
    assert seen.max() - seen.min() <= 1  # everyone's turn before anyone's next


def test_readers_skip_comments_and_blank_lines(spark, tmp_path):
    def read(reader, text):
        path = tmp_path / re.sub(r"\W", "", f"{reader.__name__}")
        path.write_text(text)
        return [tuple(r) for r in reader(spark, str(path)).collect()]

    assert read(vectors.read_spaced, "# label f1\n1 0.5 2\n\n  # more\n0 1 1\n") == [(1.0, [0.5, 2.0]), (0.0, [1.0, 1.0])]
    assert read(vectors.read_labelled_text, "#\n1,0.5 2\n") == [(1.0, [0.5, 2.0])]
    assert read(vectors.read_tabbed, "# id\ty\n7\t1\t0.5\n") == [(7, 1.0, [0.5])]
    assert [[tuple(e) for e in r[0]] for r in read(vectors.read_entries, "# x\n1:2 3:4\n\n")] == [[(0, 2.0), (2, 4.0)]]
    path = tmp_path / "keep"
    path.write_text("# x\n\n1:2\n")
    assert vectors.read_entries(spark, str(path), keep_empty=True).count() == 2
