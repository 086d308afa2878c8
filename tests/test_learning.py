import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.functions import seeded
from featherloom.plans import blocks, denoise, feedforward, sparse_ae, svm
from featherloom.plans.settings import (
    DenoiseSettings,
    NetworkSettings,
    SparseAutoencoderSettings,
    SvmSettings,
)
from featherloom.session import scratch_path
from featherloom.sources import samples

from . import fixtures

ROWS = "id BIGINT, label ARRAY<DOUBLE>, features ARRAY<DOUBLE>"


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def network_rows(spark, n=60, width=5, outputs=1, seed=0):
    gen = np.random.default_rng(seed)
    x, y = gen.uniform(0, 1, (n, width)), gen.uniform(0, 1, (n, outputs))
    rows = [(k, y[k].tolist(), x[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, ROWS).repartition(3), x, y


def test_forward_pass_with_fixed_weights(spark):
    rows, x, y = network_rows(spark)
    weights = [np.array(fixtures.NETWORK_HIDDEN), np.array(fixtures.NETWORK_OUTPUT)]
    settings = NetworkSettings(sizes=(5, 7, 1))
    found = {r["id"]: r for r in feedforward.predict(rows, weights, settings).collect()}
    ones = np.ones((len(x), 1))
    hidden = sigmoid(np.hstack([ones, x]) @ weights[0].T)
    out = np.hstack([ones, hidden]) @ weights[1].T
    for k in range(len(x)):
        assert found[k]["predicted"] == pytest.approx(out[k].tolist())
        assert found[k]["error"] == pytest.approx((y[k] - out[k]).tolist())
    assert feedforward.loss(rows, weights, settings).first()["loss"] == pytest.approx(0.5 * ((y - out) ** 2).sum() / len(x))


@pytest.mark.parametrize("activation,output", [("sigm", "sigm"), ("tanh_opt", "linear")])
def test_gradient_against_finite_differences(spark, activation, output):
    rows, x, y = network_rows(spark, n=20, width=3, outputs=2)
    settings = NetworkSettings(sizes=(3, 4, 3, 2), activation=activation, output=output)
    weights = feedforward.initial_weights(settings)
    table = feedforward.gradient_table(rows, weights, settings).collect()
    assert len(table) == sum(w.size for w in weights)

    def loss(ws):
        state = feedforward.forward_block(x, ws, settings)
        return 0.5 * ((y - state.output) ** 2).sum() / len(x)

    for row in table[::5]:
        layer, unit, slot = row["layer"], row["unit"], row["slot"]
        h = 1e-6
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[layer][unit, slot] += h
        down[layer][unit, slot] -= h
        assert row["gradient"] == pytest.approx((loss(up) - loss(down)) / (2 * h), rel=1e-4, abs=1e-8)


def test_sparsity_term_in_the_gradient():
    settings = NetworkSettings(sizes=(2, 2, 1), sparsity_penalty=0.5, sparsity_target=0.1)
    weights = [np.full((2, 3), 0.1), np.full((1, 3), 0.2)]
    x, y = np.array([[0.3, 0.6]]), np.array([[0.5]])
    state = feedforward.forward_block(x, weights, settings)
    p = [np.array([0.2, 0.4])]
    plain = feedforward.gradient_block(state, y - state.output, weights, settings, None)
    with_term = feedforward.gradient_block(state, y - state.output, weights, settings, p)
    a = state.inputs[1][:, 1:]
    extra = 0.5 * (-0.1 / p[0] + 0.9 / (1 - p[0])) * a * (1 - a)
    assert with_term[0] - plain[0] == pytest.approx(extra.T @ state.inputs[0])
    assert with_term[1] == pytest.approx(plain[1])


def test_update_rule():
    w, v, g = [np.ones((1, 2))], [np.full((1, 2), 0.5)], [np.full((1, 2), 2.0)]
    settings = NetworkSettings(sizes=(1, 1), momentum=0.5, l2=0.1)
    new_w, new_v = feedforward.apply_gradients(w, v, g, 0.1, settings)
    assert new_v[0].tolist() == [[pytest.approx(0.1 * 2.0 + 0.25), pytest.approx(0.1 * 2.1 + 0.25)]]
    assert new_w[0] == pytest.approx(1.0 - new_v[0])
    literal, _ = feedforward.apply_gradients(w, v, g, 0.1, settings.with_(l2_on_gradient=True))
    assert literal[0][0, 1] == pytest.approx(1.0 - (0.1 * 2.2 + 0.25))
    _, unchanged = feedforward.apply_gradients(w, v, g, 0.1, settings.with_(momentum=0.0))
    assert unchanged[0] == pytest.approx(v[0])


def test_dropout_scales_in_test_mode_and_masks_in_training():
    settings = NetworkSettings(sizes=(3, 50, 1), dropout=0.4)
    weights = feedforward.initial_weights(settings)
    x, ids = np.ones((40, 3)), np.arange(40)
    full = feedforward.forward_block(x, weights, settings.with_(dropout=0.0)).inputs[1][:, 1:]
    test = feedforward.forward_block(x, weights, settings).inputs[1][:, 1:]
    train = feedforward.forward_block(x, weights, settings, ids, seed=3)
    assert test == pytest.approx(full * 0.6)
    assert train.masks[1].mean() == pytest.approx(0.6, abs=0.05)
    assert train.inputs[1][:, 1:] == pytest.approx(full * train.masks[1])


def test_staged_batches_partition_the_rows_anew_each_epoch(spark):
    rows, _, _ = network_rows(spark, n=300)
    staged = feedforward.stage_rows(rows, 0.2, seed=1)
    train = {r["id"] for r in staged.where("NOT held").collect()}
    assert 0 < len(train) < 300 and staged.count() == 300
    batches = []
    for epoch in (0, 1):
        table = feedforward.stage_batches(staged, 5, 1, epoch)
        batches.append({r["id"]: r["batch"] for r in table.select("id", "batch").collect()})
        assert batches[-1].keys() == train and set(batches[-1].values()) == set(range(5))
    assert batches[0] != batches[1]


def test_no_file_holds_much_more_than_its_share(spark):
    rows = spark.range(6000).select("id", F.array(F.lit(1.0)).alias("label"), F.array(F.rand(1)).alias("features"))
    staged = feedforward.stage_rows(rows, 0.2, seed=1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = feedforward.stage_batches(staged, 479, 1, 0)
    sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / tasks
    plan = table.where(F.col("batch") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(batch), EqualTo(batch,3)]" in plan


def test_training_learns_the_sphere_and_survives_a_round_trip(spark):
    raw = samples.random_samples(spark, 400, 5, -1.0, 1.0, "sphere", seed=7)
    rows = samples.as_training_rows(raw.withColumn("y", F.col("y") / 5.0))
    settings = NetworkSettings(sizes=(5, 7, 1), activation="tanh_opt", learning_rate=0.1, rate_scaling=0.99)
    model = feedforward.train(rows, settings, 80, epochs=3, validation=0.2)
    assert model.train_losses[-1] < model.batch_losses[0] and model.validation_losses[-1] > 0
    path = scratch_path(spark, "net")
    model.save(spark, path)
    again = feedforward.TrainedNetwork.load(spark, path)
    assert again.settings == settings
    assert again.loss(rows).first()["loss"] == pytest.approx(model.loss(rows).first()["loss"])


def test_table_models_survive_a_cleaned_run(spark, tmp_path):
    from featherloom.session import release

    rows = spark.createDataFrame([(d, f"w{c}", 1.0 / (c + 1)) for d in range(6) for c in range(d + 2)], "doc INT, col STRING, value DOUBLE")
    model = sparse_ae.train(rows, SparseAutoencoderSettings(hidden=3, iterations=1))
    want = {r["doc"]: r["hidden"] for r in model.encode(rows).collect()}
    path = str(tmp_path / "sae")
    model.save(path)
    release(model.table)
    again = sparse_ae.SparseAutoencoderModel.load(spark, path)
    assert again.settings == model.settings and again.losses == model.losses
    found = {r["doc"]: r["hidden"] for r in again.encode(rows).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_stacked_models_survive_a_round_trip(spark, tmp_path):
    layers = [denoise.TiedLayer.initial(4, 3, 1), denoise.TiedLayer.initial(3, 2, 2)]
    head = denoise.SoftmaxHead(np.arange(4.0).reshape(2, 2), np.array([0.5, -0.5]))
    model = denoise.StackedModel(layers, head)
    path = str(tmp_path / "stack")
    model.save(spark, path)
    rows = spark.createDataFrame([(1, [1.0, 0.0, 1.0, 0.0])], "id BIGINT, features ARRAY<DOUBLE>")
    again = denoise.StackedModel.load(spark, path)
    assert again.predict(rows).first()["probabilities"] == pytest.approx(model.predict(rows).first()["probabilities"])


def test_wide_lines_are_scored_at_once(spark):
    import time

    rows = spark.range(2).select("id", F.array_repeat(F.lit(1.0), 100_000).alias("features"))
    model = svm.SvmModel(np.full(100_000, 0.5), -1.0, None)
    start = time.perf_counter()
    assert [r["predicted"] for r in model.predict(rows).collect()] == [49999.0, 49999.0]
    assert time.perf_counter() - start < 30


def test_too_few_rows_make_no_step(spark):
    rows, _, _ = network_rows(spark, n=20)
    settings = NetworkSettings(sizes=(5, 2, 1))
    given = [np.zeros((2, 6)), None]
    model = feedforward.train(rows, settings, 100, epochs=1, init_weights=given)
    assert model.batch_losses == [] and model.weights[0].sum() == 0
    with pytest.raises(ValueError):
        feedforward.train(rows, settings, 100, epochs=1, init_weights=[np.zeros((1, 1))])


def test_settings_are_validated():
    for bad in ({"sizes": (3,)}, {"activation": "relu"}, {"dropout": 1.0}, {"learning_rate": -1}, {"dtype": "int8"}):
        with pytest.raises(ValueError):
            NetworkSettings(**bad)
    for bad in ({"hidden": 0}, {"iterations": 0}, {"weight_low": 1.0}, {"decay_in": -1}):
        with pytest.raises(ValueError):
            SparseAutoencoderSettings(**bad)
    with pytest.raises(ValueError):
        SvmSettings(fraction=0)
    with pytest.raises(ValueError):
        DenoiseSettings(corruption=2)


def test_models_above_the_state_limit_are_refused():
    with pytest.raises(ValueError, match="weight-table"):
        feedforward.initial_weights(NetworkSettings(sizes=(100_000, 1_000, 1)))


# Sparse autoencoder.


def eight_documents(spark):
    rows = [(d + 1, c + 1, v) for d, doc in enumerate(fixtures.EIGHT_DOCUMENTS) for c, v in enumerate(doc)]
    return spark.createDataFrame(rows, "doc INT, col INT, value DOUBLE")


def fixed_table(spark):
    enc, dec = fixtures.encoder(), fixtures.decoder()
    rows = [(c + 1, enc[:, c].tolist(), dec[c, :3].tolist(), float(dec[c, 3])) for c in range(8)]
    return spark.createDataFrame(rows, "col INT, w_in ARRAY<DOUBLE>, w_out ARRAY<DOUBLE>, b_out DOUBLE")


def test_reconstruction_of_the_first_document(spark):
    found = sparse_ae.decode(eight_documents(spark), fixed_table(spark), fixtures.encoder()[:, 8])
    got = {r["col"]: r["out"] for r in found.where("doc = 1").collect()}
    assert [got[c] for c in range(1, 9)] == pytest.approx(fixtures.FIRST_RECONSTRUCTION, abs=1e-9)


def brute_force_step(docs, enc, dec, rate, decay):
    """Mean-gradient step on documents given as {column: value}."""
    w_in, b, w_out, d = enc[:, :-1].copy(), enc[:, -1].copy(), dec[:, :-1].copy(), dec[:, -1].copy()
    g_in, g_b, g_out, g_d = np.zeros_like(w_in), np.zeros_like(b), np.zeros_like(w_out), np.zeros_like(d)
    touched = set()
    for doc in docs:
        cols = sorted(doc)
        v = np.array([doc[c] for c in cols])
        touched |= set(cols)
        h = sigmoid(w_in[:, cols] @ v + b)
        r = sigmoid(w_out[cols] @ h + d[cols])
        e = (r - v) * r * (1 - r)
        back = (w_out[cols].T @ e) * h * (1 - h)
        g_in[:, cols] += np.outer(back, v)
        g_out[cols] += np.outer(e, h)
        g_d[cols] += e
        g_b += back
    n, t = len(docs), sorted(touched)
    w_in[:, t] -= rate * (g_in[:, t] / n + 2 * decay * w_in[:, t])
    w_out[t] -= rate * (g_out[t] / n + 2 * decay * w_out[t])
    d[t] -= rate * (g_d[t] / n + decay * d[t])
    b = b - rate * (g_b / n + 2 * decay * b)
    return w_in, b, w_out, d


@pytest.mark.parametrize("floor", [0, 10**9])
@pytest.mark.parametrize("unrolled", [True, False])
def test_step_matches_brute_force_with_and_without_hot_keys(spark, floor, unrolled, monkeypatch):
    if not unrolled:
        monkeypatch.setattr(sparse_ae, "MAX_SUM_COLUMNS", 0)
    gen = np.random.default_rng(5)
    docs = [{c: float(gen.random()) for c in range(8) if gen.random() < 0.5 or c == 0} for _ in range(11)]
    docs[3] = {c: float(gen.random()) for c in range(7)}
    rows = [(k, c + 1, v) for k, doc in enumerate(docs) for c, v in doc.items()]
    triples = spark.createDataFrame(rows, "doc INT, col INT, value DOUBLE")
    settings = SparseAutoencoderSettings(hidden=3, learning_rate=0.3, decay_in=0.05, decay_out=0.05, decay_bias=0.05)
    spread = sparse_ae.Spread.of(triples, pieces=20, floor=floor)
    assert (spread.hot_cols.table is None) == (floor > 0)
    done = sparse_ae.step(spread, fixed_table(spread.rows.sparkSession), fixtures.encoder()[:, 8], settings)
    w_in, b, w_out, d = brute_force_step(docs, fixtures.encoder(), fixtures.decoder(), 0.3, 0.05)
    assert done.hidden_bias == pytest.approx(b)
    for r in done.table.collect():
        c = r["col"] - 1
        assert r["w_in"] == pytest.approx(w_in[:, c].tolist())
        assert r["w_out"] == pytest.approx(w_out[c].tolist())
        assert r["b_out"] == pytest.approx(d[c])


def test_sparse_training_lowers_the_loss(spark):
    settings = SparseAutoencoderSettings(
        hidden=3, learning_rate=2.0, iterations=3, decay_in=0.0, decay_out=0.0, decay_bias=0.0
    )
    model = sparse_ae.train(eight_documents(spark), settings)
    assert model.losses[-1] < model.losses[0]
    encoded = model.encode(eight_documents(spark)).collect()
    assert len(encoded) == 8 and all(len(r["hidden"]) == 3 for r in encoded)
    in_batches = sparse_ae.train(eight_documents(spark), settings.with_(iterations=1), batches=2)
    assert len(in_batches.losses) == 1


def test_replicas(spark):
    cols = eight_documents(spark)
    settings = SparseAutoencoderSettings(hidden=2)
    same = sparse_ae.replicas(cols, settings, 3).groupBy("col").agg(F.countDistinct("w_in").alias("n")).collect()
    assert len(same) == 8 and all(r["n"] == 1 for r in same)
    apart = sparse_ae.replicas(cols, settings, 3, True).groupBy("col").agg(F.countDistinct("w_in").alias("n")).collect()
    assert all(r["n"] == 3 for r in apart)


# Denoising autoencoder.


def bit_rows(spark, data, labels=None):
    if labels is None:
        return spark.createDataFrame([(k, r) for k, r in enumerate(data)], "id BIGINT, features ARRAY<DOUBLE>")
    return spark.createDataFrame([(k, y, r) for k, (r, y) in enumerate(zip(data, labels))], ROWS)


def test_denoising_step_is_the_cross_entropy_gradient(spark):
    data = fixtures.two_groups(6, 4)
    layer = denoise.TiedLayer.initial(6, 3, seed=2)
    sums = blocks.collect_sums(denoise.denoise_sums(bit_rows(spark, data), layer, 0.0, seed=1))
    x = np.array(data)

    def likelihood(w):
        z = sigmoid(sigmoid(x @ w.T) @ w)
        return (x * np.log(z) + (1 - x) * np.log(1 - z)).sum()

    for h, v in [(0, 0), (1, 4), (2, 5)]:
        up, down = layer.w.copy(), layer.w.copy()
        up[h, v] += 1e-6
        down[h, v] -= 1e-6
        assert sums["w"][h, v] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-6, rel=1e-4)


def test_denoising_training_lowers_the_error(spark):
    rows = bit_rows(spark, fixtures.two_groups(20, 10))
    layer, errors = denoise.train_layer(rows, DenoiseSettings(hidden=5, learning_rate=3.0, epochs=12, corruption=0.1))
    assert errors[-1] < errors[0]
    found = denoise.reconstruct(rows, layer).first()
    assert len(found["reconstructed"]) == 20 and len(found["hidden"]) == 5


def test_stack_separates_two_groups(spark):
    labels = [[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 5
    rows = bit_rows(spark, fixtures.two_groups(28, 10), labels)
    settings = DenoiseSettings(hidden=6, learning_rate=2.0, epochs=8, corruption=0.1)
    model = denoise.train_stack(rows, [6], 2, settings, head_rate=2.0, head_epochs=12)
    found = model.predict(rows).collect()
    assert all(np.argmax(r["probabilities"]) == np.argmax(r["label"]) for r in found)
    assert all(sum(r["probabilities"]) == pytest.approx(1.0) for r in found)


# SVM.


def test_dense_svm_against_numpy(spark):
    gen = np.random.default_rng(1)
    x = gen.normal(size=(80, 4))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0]) > 0).astype(int)
    rows = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(80)], "id BIGINT, label INT, features ARRAY<DOUBLE>")
    w, s = np.zeros(4), 2 * y - 1
    for t in range(1, 6):
        active = s * (x @ w) < 1
        w = w * (1 - 0.01 / np.sqrt(t)) + (s[active, None] * x[active]).sum(axis=0) / 80 / np.sqrt(t)
    model = svm.train(rows, SvmSettings(iterations=5, tolerance=0.0))
    assert model.weights == pytest.approx(w)
    predicted = model.predict(rows).select((F.col("predicted") == F.col("label")).alias("ok")).collect()
    assert sum(r["ok"] for r in predicted) > 70
    biased = svm.train(rows, SvmSettings(iterations=2), initial=np.ones(4), intercept=True)
    assert len(biased.weights) == 4 and biased.intercept != 0.0


def test_sparse_svm_equals_dense(spark):
    gen = np.random.default_rng(2)
    x = gen.normal(size=(30, 5)) * (gen.random((30, 5)) < 0.7)
    y = gen.integers(0, 2, 30)
    dense = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(30)], "id BIGINT, label INT, features ARRAY<DOUBLE>")
    cells = [(k, c, float(x[k, c])) for k in range(30) for c in range(5) if x[k, c]]
    triples = spark.createDataFrame(cells, "doc BIGINT, col INT, value DOUBLE")
    labels = dense.select(F.col("id").alias("doc"), "label")
    settings = SvmSettings(iterations=3, tolerance=0.0)
    found = {r["col"]: r["w"] for r in svm.train_sparse(triples, labels, settings).collect()}
    kept = {k for k, _, _ in cells}
    model = svm.train(dense.where(F.col("id").isin(*kept)), settings)
    assert [found[c] for c in range(5)] == pytest.approx(model.weights.tolist())


def test_svm_refuses_other_labels_and_keeps_its_threshold(spark):
    rows = spark.createDataFrame([(1, 2, [1.0])], "id BIGINT, label INT, features ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="not 0 or 1"):
        svm.train(rows, SvmSettings(iterations=1))
    model = svm.SvmModel(np.array([1.0, -1.0]), 0.5).set_threshold(0.25)
    path = scratch_path(spark, "svm")
    model.save(spark, path)
    again = svm.SvmModel.load(spark, path)
    assert again.threshold == 0.25 and again.intercept == 0.5
    with pytest.raises(ValueError):
        feedforward.TrainedNetwork.load(spark, path)
    at = spark.createDataFrame([([0.0, 0.25],), ([0.0, 0.2],)], "features ARRAY<DOUBLE>")
    assert [r["predicted"] for r in again.predict(at).collect()] == [0.0, 1.0]
    assert again.clear_threshold().predict(at).first()["predicted"] == pytest.approx(0.25)


def test_cell_draws_do_not_depend_on_the_batch():
    ids = np.arange(100)
    whole = blocks.cell_draws(ids, 6, 9)
    assert (whole[40:60] == blocks.cell_draws(ids[40:60], 6, 9)).all()
    assert abs(whole.mean() - 0.5) < 0.05 and (whole != blocks.cell_draws(ids, 6, 10)).any()


def test_hashed_and_modular_draws_differ_by_seed(spark):
    rows = spark.range(20)
    for family in (seeded.hashed, seeded.modular):
        a = [r[0] for r in rows.select(family(1)(F.col("id"), F.lit(0))).collect()]
        b = [r[0] for r in rows.select(family(2)(F.col("id"), F.lit(0))).collect()]
        assert a != b
