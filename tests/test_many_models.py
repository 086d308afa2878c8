"""Nearest centres against all pairs, and models side by side against one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.functions import seeded
from featherloom.operators import distances
from featherloom.operators.splits import fold_column
from featherloom.plans import side_by_side, svm
from featherloom.plans.settings import SvmSettings


def test_bounds_hold_and_close_centres_are_told_apart():
    gen = np.random.default_rng(8)
    base = gen.normal(size=(30, 16)) * 1e4
    # Duplicates, and centres that differ in the last digits of large components.
    vectors = np.concatenate([base, base[:5], base[:10] + gen.normal(size=(10, 16)) * 1e-6])
    x = np.concatenate([vectors + 1e-7, gen.normal(size=(200, 16)) * 1e4])
    centres = distances.Centres(distances.pa.array(np.arange(len(vectors))), vectors, (vectors**2).sum(axis=1))
    place, found = distances.nearest_of(x, centres)
    pairs = ((x[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    assert (place == pairs.argmin(axis=1)).all() and found == pytest.approx(pairs.min(axis=1), rel=1e-12)
    squares = (x**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)
    fast = squares - 2.0 * (x @ vectors.T)
    assert (np.abs(fast - pairs) <= distances.error_bound(16, squares)).all()
    # The product alone picks wrong ones here.
    assert (fast.argmin(axis=1) != pairs.argmin(axis=1)).any()


@pytest.mark.parametrize("limit", [None, 300])
def test_nearest_centre_in_one_tile_or_many(spark, monkeypatch, limit):
    monkeypatch.setattr(distances, "BLOCK", 4)
    gen = np.random.default_rng(9)
    vectors = gen.normal(size=(7, 3))
    vectors[5] = vectors[2]
    names = ["f", "b", "e", "a", "g", "c", "d"]
    x = np.concatenate([gen.normal(size=(40, 3)), vectors])
    data = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [1.0, float("nan"), 2.0], None)]
    rows = spark.createDataFrame(data, "id BIGINT, features ARRAY<DOUBLE>, centre STRING")
    listed = [(n, v.tolist()) for n, v in zip(names, vectors)] + [("z", None), ("y", [0.0, None, 0.0]), ("x", [float("inf")] * 3)]
    centres = spark.createDataFrame(listed, "centre STRING, vector ARRAY<DOUBLE>")
    found = {r["id"]: r for r in distances.nearest_centre(rows, centres, limit=limit).collect()}
    assert len(found) == len(data)
    for k, v in enumerate(x):
        d = ((v - vectors) ** 2).sum(axis=1)
        assert found[k]["nearest"] == min(n for n, own in zip(names, d) if own == d.min())
        assert found[k]["distance"] == pytest.approx(d.min(), abs=1e-12)
    assert all(found[k]["nearest"] is None and found[k]["distance"] is None for k in (100, 101, 102))


def test_no_centres_and_wrong_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id BIGINT, features ARRAY<DOUBLE>")
    none = spark.createDataFrame([], "centre INT, vector ARRAY<DOUBLE>")
    assert distances.nearest_centre(rows, none).first()["nearest"] is None
    with pytest.raises(Exception, match="different lengths"):
        distances.nearest_centre(rows, spark.createDataFrame([(1, [1.0])], none.schema)).collect()


def test_one_tile_is_a_projection(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id BIGINT, features ARRAY<DOUBLE>")
    centres = spark.createDataFrame([(1, [1.0, 0.0])], "centre INT, vector ARRAY<DOUBLE>")
    assert "Exchange" not in distances.nearest_centre(rows, centres)._jdf.queryExecution().executedPlan().toString()


def labelled(spark, n=120, width=4):
    gen = np.random.default_rng(10)
    x = gen.normal(size=(n, width))
    y = (x @ np.arange(1, width + 1) > 0).astype(float)
    rows = [(k, float(y[k]), x[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "id BIGINT, label DOUBLE, features ARRAY<DOUBLE>").repartition(3)


@pytest.mark.parametrize("tolerance", [0.0, 0.3])
def test_folds_side_by_side_equal_folds_one_by_one(spark, tolerance):
    rows, settings, draw = labelled(spark), SvmSettings(iterations=6, tolerance=tolerance), seeded.modular(5)
    fold = fold_column("id", 3, draw)
    together = side_by_side.train(rows, side_by_side.Masks.folds(fold, 3), settings)
    for k in range(3):
        alone = svm.train(rows.where(fold != k), settings)
        assert together[k] == pytest.approx(alone.weights, abs=1e-12)
    scored = side_by_side.cross_validate(rows, 3, draw, settings).collect()
    features = {r["id"]: np.array(r["features"]) for r in rows.collect()}
    assert len(scored) == 120
    for r in scored:
        assert r["margin"] == pytest.approx(features[r["id"]] @ together[r["fold"]], abs=1e-12)
    errors = side_by_side.fold_errors(side_by_side.cross_validate(rows, 3, draw, settings)).collect()
    assert sum(r["rows"] for r in errors) == 120 and all(r["error_rate"] < 0.3 for r in errors)


def test_shares_are_scored_on_what_they_have_not_seen(spark):
    rows, settings = labelled(spark), SvmSettings(iterations=3, tolerance=0.0)
    draws = [seeded.modular(7), seeded.modular(8)]
    found = side_by_side.sweep(rows, [0.3, 0.8], draws, settings).collect()
    for share, draw in zip([0.3, 0.8], draws):
        inside = draw(F.col("id"), F.lit(0)) < share
        model = svm.train(rows.where(inside), settings)
        want = {r["id"]: float(np.array(r["features"]) @ model.weights) for r in rows.where(~inside).collect()}
        got = {r["id"]: r["margin"] for r in found if r["train_share"] == share}
        assert got == pytest.approx(want)


def test_a_model_without_rows_stays_at_zero_and_bad_arguments_fail(spark):
    rows = labelled(spark, 10)
    masks = side_by_side.Masks(F.array(F.lit(True), F.lit(False)), 2)
    w = side_by_side.train(rows, masks, SvmSettings(iterations=2))
    assert (w[1] == 0).all() and (w[0] != 0).any()
    with pytest.raises(ValueError):
        side_by_side.train(rows, masks, SvmSettings(fraction=0.5))
    with pytest.raises(ValueError):
        side_by_side.Masks.shares("id", [0.5], [])
    with pytest.raises(ValueError):
        side_by_side.train(rows.where("id < 0"), masks, SvmSettings())
