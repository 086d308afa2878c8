"""The sparse autoencoder on slices of hidden units and blocks of columns equals the broadcast form."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.operators import joins
from featherloom.plans import sliced_ae, sparse_ae
from featherloom.plans.settings import SparseAutoencoderSettings
from featherloom.session import seal

SETTINGS = SparseAutoencoderSettings(hidden=3, learning_rate=0.3, iterations=1, decay_in=0.01, decay_out=0.02, decay_bias=0.03, seed=3)
#: Bytes a tile may have: whole slices of all columns, then blocks of the columns.
LIMITS = [2950, 1000]


@pytest.fixture(scope="module")
def triples(spark):
    gen = np.random.default_rng(6)
    rows = [(d, f"c{c}", float(gen.uniform())) for d in range(40) for c in gen.choice(60, gen.integers(1, 12), replace=False)]
    return seal(spark.createDataFrame(rows, "doc BIGINT, col STRING, value DOUBLE").repartition(3), "triples")


@pytest.fixture(scope="module")
def table(spark, triples):
    extra = spark.createDataFrame([("unseen", [0.1] * 3, [0.2] * 3, 0.3)], "col STRING, w_in ARRAY<DOUBLE>, w_out ARRAY<DOUBLE>, b_out DOUBLE")
    return seal(sparse_ae.initial_weight_table(triples, SETTINGS).unionByName(extra), "weights")


BIAS = np.linspace(-0.3, 0.4, 3)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(found, wanted, keys, names):
    found, wanted = rows(found, *keys), rows(wanted, *keys)
    assert found.keys() == wanted.keys()
    for key, row in wanted.items():
        for name in names:
            assert found[key][name] == pytest.approx(row[name], abs=1e-12)


def test_tile_shapes_stay_within_the_limit():
    for columns, units, limit in [(61_188, 800, 64 << 20), (60, 7, 3000), (60, 7, 900), (10_000_000, 800, 64 << 20), (0, 3, 100), (5, 1, 1)]:
        block, width = sliced_ae.tile_shape(columns, units, limit)
        assert 1 <= width <= units and block >= 1
        assert block * (16 * width + 16) <= max(limit, 32)
    assert sliced_ae.tile_shape(61_188, 800, 64 << 20) == (61_188, 67)


@pytest.mark.parametrize("limit", LIMITS)
def test_cut_and_whole_table(triples, table, limit):
    slices = sliced_ae.cut(table, 3, limit)
    assert len(slices.tables) > 1 and (len(slices.blocks) > 1) == (limit == 1000)
    assert sorted(r["code"] for r in slices.codes.collect()) == list(range(slices.columns))
    same(sliced_ae.whole_table(slices), table, ["col"], ["w_in", "w_out", "b_out"])


@pytest.mark.parametrize("limit", LIMITS)
def test_every_operation_equals_the_broadcast_form(monkeypatch, triples, table, limit):
    spread = sparse_ae.Spread.of(triples)
    hidden = seal(sparse_ae.encode(triples, table, BIAS), "hidden")

    def results():
        done = sparse_ae.step(spread, table, BIAS, SETTINGS)
        found = {
            "pass": (sparse_ae.document_pass(spread, table, BIAS), ["doc"], ["hidden", "hidden_error", "loss"]),
            "step": (done.table, ["col"], ["w_in", "w_out", "b_out"]),
        }
        if limit == LIMITS[0]:
            found |= {
                "z": (sparse_ae.project(triples, table, BIAS), ["doc"], ["z"]),
                "hidden": (sparse_ae.encode(triples, table, BIAS), ["doc"], ["hidden"]),
                "out": (sparse_ae.decode(triples, table, BIAS), ["doc", "col"], ["value", "out"]),
            }
        else:
            found["given"] = sparse_ae.decode_hidden(hidden, triples, table, 3), ["doc", "col"], ["value", "out"]
        return found, done

    plain, whole = results()
    plain = {k: (seal(d, "plain"), *rest) for k, (d, *rest) in plain.items()}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    sliced, done = results()
    for name, (df, keys, names) in sliced.items():
        same(df, plain[name][0], keys, names)
    assert done.hidden_bias == pytest.approx(whole.hidden_bias, abs=1e-12)
    assert done.loss == pytest.approx(whole.loss)


@pytest.mark.parametrize("batches", [2])
def test_training_equals_the_broadcast_form(monkeypatch, triples, batches):
    plain = sparse_ae.train(triples, SETTINGS, batches)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", LIMITS[0])
    sliced = sparse_ae.train(triples, SETTINGS, batches)
    same(sliced.table, plain.table, ["col"], ["w_in", "w_out", "b_out"])
    assert sliced.hidden_bias == pytest.approx(plain.hidden_bias, abs=1e-12)
    assert sliced.losses == pytest.approx(plain.losses)
    same(sliced.encode(triples), plain.encode(triples), ["doc"], ["hidden"])


@pytest.mark.parametrize("limit", LIMITS)
def test_no_weight_array_crosses_an_exchange(triples, table, limit):
    slices = sliced_ae.cut(table, 3, limit)
    docs = sliced_ae.documents(triples, slices)
    state = sliced_ae.forward(docs, slices, BIAS)
    a, b = slices.blocks[0]
    tile = sliced_ae.Tile.load(slices, 0, a, b)
    state = sliced_ae.backward(state, slices) if len(slices.blocks) > 1 else state
    gradients = sliced_ae.tile_gradients(state, slices, 0, a, b, tile)
    text = gradients._jdf.queryExecution().executedPlan().toString()
    # One exchange, of gradients already summed in each task.
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", text) == ["code"] and "w_in" not in text
    moved = seal(sliced_ae.moved_rows(gradients.where("code >= 0"), slices, 0, tile, 40.0, SETTINGS), "moved")
    text = sliced_ae.replaced(slices.tables[0], moved)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text


def test_no_documents(spark, triples, table):
    slices = sliced_ae.cut(table, 3, LIMITS[0])
    docs = sliced_ae.documents(triples.where(F.col("doc") < 0), slices)
    assert sliced_ae.step(docs, slices, BIAS, SETTINGS) is None


def test_a_step_on_slices_equals_the_one_by_frequent_words(monkeypatch, triples, table):
    """Narrow layers join rare words' weights instead of working off a job a tile; both give the same weights."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 2950)
    spread = sparse_ae.Spread.of(triples)
    assert not sparse_ae.in_slices(table, 3) and 0 < spread.frequent(30).count() <= 30
    joined = sparse_ae.step(spread, table, BIAS, SETTINGS)
    monkeypatch.setattr(sparse_ae, "SLICED_UNITS", 1)
    assert sparse_ae.in_slices(table, 3)
    sliced = sparse_ae.step(spread, table, BIAS, SETTINGS)
    same(joined.table, sliced.table, ["col"], ["w_in", "w_out", "b_out"])
    assert joined.hidden_bias == pytest.approx(sliced.hidden_bias, abs=1e-12)
    # Blocks of columns, whose number grows with the vocabulary, are never taken.
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    assert not sparse_ae.in_slices(table, 3)
