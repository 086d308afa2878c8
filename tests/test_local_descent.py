"""Local descent against a serial walk in NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featherloom.operators import joins
from featherloom.plans import blocks, feedforward, local_descent, sparse_ae
from featherloom.plans.settings import NetworkSettings, SparseAutoencoderSettings
from featherloom.session import seal

from .test_learning import network_rows, sigmoid

SETTINGS = SparseAutoencoderSettings(hidden=3, learning_rate=0.3, iterations=2, decay_in=0.01, decay_out=0.02, decay_bias=0.03, seed=5)


def documents(seed=1, docs=23, cols=17):
    gen = np.random.default_rng(seed)
    return {d: {int(c): float(gen.uniform()) for c in gen.choice(cols, gen.integers(1, 6), replace=False)} for d in range(docs)}


def frame(spark, docs):
    rows = [(d, f"c{c}", v) for d, own in docs.items() for c, v in own.items()]
    return spark.createDataFrame(rows, "doc BIGINT, col STRING, value DOUBLE").repartition(3)


def walk(docs, table, bias, s):
    """One serial pass over documents in the given order, on copies."""
    table = {c: [x.copy() if isinstance(x, np.ndarray) else x for x in w] for c, w in table.items()}
    losses = []
    for own in docs:
        cols, v = list(own), np.array(list(own.values()))
        w_in, w_out = np.array([table[c][0] for c in cols]), np.array([table[c][1] for c in cols])
        b = np.array([table[c][2] for c in cols])
        h = sigmoid(v @ w_in + bias)
        out = sigmoid(w_out @ h + b)
        losses.append(((out - v) ** 2).mean())
        e = (out - v) * out * (1 - out)
        d = (w_out.T @ e) * h * (1 - h)
        for k, c in enumerate(cols):
            table[c][0] = w_in[k] - s.learning_rate * (v[k] * d + 2 * s.decay_in * w_in[k])
            table[c][1] = w_out[k] - s.learning_rate * (e[k] * h + 2 * s.decay_out * w_out[k])
            table[c][2] = b[k] - s.learning_rate * (e[k] + s.decay_bias * b[k])
        bias = bias - s.learning_rate * (d + 2 * s.decay_bias * bias)
    return table, bias, losses


def start(spark, docs):
    table = seal(sparse_ae.initial_weight_table(frame(spark, docs), SETTINGS), "weights")
    weights = {r["col"]: [np.array(r["w_in"]), np.array(r["w_out"]), r["b_out"]] for r in table.collect()}
    return table, weights, sparse_ae.initial_hidden_bias(SETTINGS)


def named(docs, order):
    return [{f"c{c}": v for c, v in sorted(docs[d].items())} for d in order]


def close(model, table, bias):
    found = {r["col"]: r for r in model.table.collect()}
    assert found.keys() == table.keys()
    for c, (w_in, w_out, b) in table.items():
        assert found[c]["w_in"] == pytest.approx(w_in.tolist(), abs=1e-12)
        assert found[c]["w_out"] == pytest.approx(w_out.tolist(), abs=1e-12)
        assert found[c]["b_out"] == pytest.approx(b, abs=1e-12)
    assert model.hidden_bias == pytest.approx(bias, abs=1e-12)


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_replica_is_the_serial_descent(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(local_descent, "fits_broadcast", lambda *a: False)
    docs = documents()
    table, weights, bias = start(spark, docs)
    model = local_descent.train_sparse(frame(spark, docs), SETTINGS, 1, order=-F.col("doc"), table=table, hidden_bias=bias)
    losses = []
    for _ in range(2):
        weights, bias, met = walk(named(docs, sorted(docs, reverse=True)), weights, bias, SETTINGS)
        losses.append(np.mean(met))
    close(model, weights, bias)
    assert model.losses == pytest.approx(losses)
    assert table.count() == len(weights)  # the caller's table is left alone


@pytest.mark.parametrize("broadcast", [True, False])
def test_replicas_are_averaged_by_the_documents_that_changed_a_weight(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(local_descent, "fits_broadcast", lambda *a: False)
    docs = documents(seed=2)
    table, weights, bias = start(spark, docs)
    extra = spark.createDataFrame([("unseen", [0.1] * 3, [0.2] * 3, 0.3)], table.schema)
    wider = seal(table.unionByName(extra), "weights")
    model = local_descent.train_sparse(frame(spark, docs), SETTINGS, replica=F.col("doc") % 4, order=F.col("doc"), table=wider, hidden_bias=bias)
    for _ in range(2):
        parts = []
        for r in range(4):
            own = named(docs, [d for d in sorted(docs) if d % 4 == r])
            moved, b, _ = walk(own, weights, bias, SETTINGS)
            parts.append((moved, b, own))
        bias = sum(b * len(own) for _, b, own in parts) / len(docs)
        following = {}
        for c in weights:
            n = [sum(c in d for d in own) for _, _, own in parts]
            following[c] = [sum(moved[c][k] * m for (moved, _, _), m in zip(parts, n)) / sum(n) for k in range(3)]
        weights = following
    weights["unseen"] = [np.full(3, 0.1), np.full(3, 0.2), 0.3]
    close(model, weights, bias)


def test_default_deal_learns(spark):
    docs = documents(seed=3, docs=60)
    model = local_descent.train_sparse(frame(spark, docs), SETTINGS.with_(iterations=4, decay_in=0.0, decay_out=0.0, decay_bias=0.0), replicas=5)
    assert len(model.losses) == 4 and model.losses[-1] < model.losses[0]
    assert model.encode(frame(spark, docs)).count() == 60
    with pytest.raises(ValueError):
        local_descent.train_sparse(frame(spark, docs), SETTINGS, replicas=0)


def test_weights_that_travel_are_sent_once_a_replica(spark, monkeypatch):
    """Neither plan has a weight array per word: only the replica's own columns, or a broadcast."""
    docs = documents()
    table, _, bias = start(spark, docs)
    rows = local_descent.document_rows(frame(spark, docs), F.col("doc") % 2, F.col("doc"))
    whole = local_descent.descend(rows, local_descent._collected(table, bias), SETTINGS)
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "w_in" not in text.split("MapInArrow")[1].split("Exchange", 1)[1]


@pytest.mark.parametrize("limit", [0, 300, 1000])
@pytest.mark.parametrize("replicas", [1, 4])
def test_small_blocks_and_parted_weights_give_the_serial_descent(spark, monkeypatch, limit, replicas):
    """Replicas go on over blocks of a row or two, with all, some or none of the weights sent along (F15)."""
    docs = documents(seed=4)
    table, weights, bias = start(spark, docs)
    row = 8 * (2 * SETTINGS.hidden + 1)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit * (row + 64) // 100)
    near = local_descent._frequent(frame(spark, docs), SETTINGS.hidden)
    cols = local_descent._names(near)
    rows = local_descent.document_rows(frame(spark, docs), F.col("doc") % replicas, F.col("doc"), cols)
    touched = local_descent._touched(rows)
    held = {r["col"] for r in near.collect()}
    assert len(held) <= limit // 100 and held.isdisjoint(r["col"] for r in touched.collect())
    pairs = {(d % replicas, f"c{c}") for d, own in docs.items() for c in own}
    assert {(r["replica"], r["col"]) for r in touched.collect()} == {p for p in pairs if p[1] not in held}

    monkeypatch.setattr(local_descent, "BLOCK_BYTES", 4 * row)
    monkeypatch.setattr(local_descent, "LOOKUP_CELLS", 7)
    shared = local_descent._collected(table.join(near, "col", "left_semi"), bias, cols)
    stream = rows.unionByName(local_descent.weight_rows(touched, table)).coalesce(1).sortWithinPartitions("replica", "kind", "place", "doc")
    task, parts = local_descent.Walk(shared, SETTINGS), []
    for batch in stream.toArrow().to_batches(max_chunksize=3):
        parts += task.read(batch)
    parts += task.learned()
    sums = {}
    for r in (r for p in parts for r in p.to_pylist()):
        one = np.array([*r["w_in"], *r["w_out"], r["b_out"]]) * r["n"]
        old, n = sums.get(r["col"], (0.0, 0.0))
        sums[r["col"]] = old + one, n + r["n"]

    expected = {}
    for k in range(replicas):
        own = named(docs, [d for d in sorted(docs) if d % replicas == k])
        moved, b, losses = walk(own, weights, bias, SETTINGS)
        for c in {c for d in own for c in d}:
            n = sum(c in d for d in own)
            old, m = expected.get(c, (0.0, 0))
            expected[c] = old + n * np.array([*moved[c][0], *moved[c][1], moved[c][2]]), m + n
        old, m = expected.get(None, (0.0, 0))
        expected[None] = old + np.array([*(b * len(own)), 0.0, 0.0, 0.0, sum(losses)]), m + len(own)
    assert sums.keys() == expected.keys()
    for c, (w, n) in expected.items():
        assert sums[c][1] == n and sums[c][0] == pytest.approx(w, abs=1e-12)


@pytest.mark.parametrize("known", [[], ["c11", "c3"]])
def test_documents_in_pieces_are_whole_and_sorted(spark, known):
    """Cells that lie apart come together, known columns by their places, and the order of the rows doesn't matter (F15)."""
    docs = documents(seed=6)
    cells = frame(spark, docs).orderBy("col")
    found = local_descent.document_rows(cells, F.col("doc") % 4, -F.col("doc"), pa.array(known, pa.string())).collect()
    assert len(found) == len(docs)
    for r in found:
        own = named(docs, [r["doc"]])[0]
        ids = [k for k, c in enumerate(known) if c in own]
        cols = sorted(c for c in own if c not in known)
        assert (r["replica"], r["kind"], r["place"], r["w"]) == (r["doc"] % 4, 1, -r["doc"], [])
        assert r["ids"] == ids and r["cols"] == cols
        assert r["vals"] == [own[known[k]] for k in ids] + [own[c] for c in cols]


def test_a_task_hands_on_one_row_a_column(spark):
    """What replicas of a task have learned is added up there: rows grow with columns, not with replicas (F15)."""
    docs = documents(docs=200)
    table, _, bias = start(spark, docs)
    shared = local_descent._collected(table, bias)
    rows = local_descent.document_rows(frame(spark, docs), F.floor(F.col("doc") / 2), F.col("doc"), shared.cols)
    learned = local_descent.descend(rows, shared, SETTINGS)
    told = learned.withColumn("task", F.spark_partition_id()).groupBy("task", "col").count()
    assert told.agg(F.max("count")).first()[0] == 1
    assert learned.agg(F.sum("n")).first()[0] == sum(len(own) for own in docs.values()) + len(docs)


@pytest.mark.parametrize("batch,replicas", [(1, 1), (4, 1), (7, 3)])
def test_network_replicas_walk_their_rows_in_order(spark, batch, replicas):
    rows, x, y = network_rows(spark, n=50, width=4, outputs=2)
    settings = NetworkSettings(sizes=(4, 3, 2), output="sigm", learning_rate=0.4, momentum=0.5, l2=0.01, rate_scaling=0.9)
    start = feedforward.initial_weights(settings)
    model = local_descent.train_network(rows, settings, batch, 2, replica=F.col("id") % replicas, order=-F.col("id"), init_weights=start)
    common, rate, losses = start, 0.4, []
    for _ in range(2):
        total, squared = [np.zeros_like(w) for w in common], 0.0
        for r in range(replicas):
            own = np.array([k for k in range(49, -1, -1) if k % replicas == r])
            w, v = common, feedforward.zero_like(common)
            for k in range(0, len(own), batch):
                part = own[k : k + batch]
                state = feedforward.forward_block(x[part], w, settings)
                error = y[part] - state.output
                squared += (error**2).sum()
                g = [m / len(part) for m in feedforward.gradient_block(state, error, w, settings, None)]
                w, v = feedforward.apply_gradients(w, v, g, rate, settings)
            total = [t + m * len(own) for t, m in zip(total, w)]
        common = [t / 50 for t in total]
        losses.append(0.5 * squared / 50)
        rate *= 0.9
    for found, want in zip(model.weights, common):
        assert found == pytest.approx(want, abs=1e-12)
    assert model.train_losses == pytest.approx(losses)


def test_jobs_of_a_round_do_not_depend_on_the_number_of_updates(spark):
    rows, _, _ = network_rows(spark, n=64, width=4)
    settings = NetworkSettings(sizes=(4, 2, 1))
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for batch in (64, 1):
        group = f"local-{batch}"
        spark.sparkContext.setJobGroup(group, group)
        local_descent.train_network(rows, settings, batch, 1, replicas=4)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[0] == jobs[1] > 0


def test_noisy_network_settings_and_no_rows(spark):
    rows, _, _ = network_rows(spark, n=40, width=4)
    settings = NetworkSettings(sizes=(4, 3, 1), output="sigm", sparsity_penalty=0.01, input_mask=0.2, dropout=0.25, dtype="float32")
    once, again = (local_descent.train_network(rows, settings, 5, 2, replicas=3) for _ in range(2))
    assert all((a == b).all() for a, b in zip(once.weights, again.weights))
    none = local_descent.train_network(rows.where("id < 0"), settings, 5, 2)
    assert none.train_losses == [] and none.weights[0].shape == (3, 5)
    with pytest.raises(ValueError):
        local_descent.train_network(rows, settings, 0, 1)


def test_sums_meet_in_two_levels(spark):
    rows, _, _ = network_rows(spark, n=60, width=4)
    settings = NetworkSettings(sizes=(4, 2, 1))
    sums = feedforward.step_sums(rows.repartition(50), feedforward.initial_weights(settings), settings)
    text = sums._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(name") == 2 and "Coalesce" not in text
    assert blocks.collect_sums(sums)["loss"][0][1] == 60
    assert joins.BROADCAST_BYTES > 0
