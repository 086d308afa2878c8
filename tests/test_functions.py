import math

import pytest
from pyspark.sql import functions as F

from featherloom.functions import activations, seeded, surfaces
from featherloom.functions import vectors as V


def one(spark, expr, **columns):
    schema = ", ".join(f"{n} {'ARRAY<DOUBLE>' if isinstance(v, list) else 'DOUBLE'}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr.alias("r")).first()["r"]


def test_activations(spark):
    assert one(spark, activations.sigmoid("x"), x=0.0) == 0.5
    assert one(spark, activations.scaled_tanh("x"), x=1.5) == pytest.approx(1.7159 * math.tanh(1.0))
    a = 1.7159 * math.tanh(2 / 3 * 0.4)
    h = 1e-6
    numeric = (1.7159 * math.tanh(2 / 3 * (0.4 + h)) - 1.7159 * math.tanh(2 / 3 * (0.4 - h))) / (2 * h)
    assert one(spark, activations.scaled_tanh_slope("a"), a=a) == pytest.approx(numeric, rel=1e-6)


def test_softmax_survives_large_values(spark):
    got = one(spark, activations.softmax_all("a"), a=[1000.0, 1000.0, 0.0])
    assert got == pytest.approx([0.5, 0.5, 0.0])


@pytest.mark.parametrize("x", [-800.0, -1.0, 0.0, 2.0, 800.0])
def test_log1p_exp(spark, x):
    expected = x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))
    assert one(spark, activations.log1p_exp("x"), x=x) == pytest.approx(expected, abs=1e-12)


def test_distance_by_norms_falls_back_when_norms_are_close(spark):
    a = [1.0, 1e-9]
    b = [1.0, 0.0]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    got = one(spark, V.squared_distance_by_norms("a", "b", "na", "nb"), a=a, b=b, na=norm(a), nb=norm(b))
    assert got == pytest.approx(1e-18, rel=1e-6)
    c = [100.0, 3.0]
    got = one(spark, V.squared_distance_by_norms("a", "b", "na", "nb"), a=c, b=b, na=norm(c), nb=norm(b))
    assert got == pytest.approx(99.0**2 + 9.0)


def test_surfaces(spark):
    x = [1.0, 1.0, 1.0]
    assert one(spark, surfaces.rosenbrock("x"), x=x) == 0.0
    assert one(spark, surfaces.sphere("x"), x=[1.0, 2.0]) == 5.0
    assert one(spark, surfaces.rastrigin("x"), x=[0.0, 0.0]) == pytest.approx(0.0)
    assert one(spark, surfaces.rosenbrock("x"), x=[2.0]) == 0.0
    with pytest.raises(ValueError):
        surfaces.surface("plane", "x")


def test_entries_and_back(spark):
    dense = [0.0, 2.0, 0.0, 4.0]
    assert one(spark, V.from_entries(V.to_entries("a"), 4), a=dense) == dense
    assert len(one(spark, V.to_entries("a"), a=dense)) == 2
    assert len(one(spark, V.to_entries("a", keep_zeros=True), a=dense)) == 4
    assert one(spark, V.from_entries(V.to_entries("a", base=1), 4, base=1), a=dense) == dense


def test_index_order(spark):
    assert one(spark, V.is_strictly_ascending("a"), a=[1.0, 2.0, 5.0])
    assert not one(spark, V.is_strictly_ascending("a"), a=[1.0, 1.0])
    assert one(spark, V.is_strictly_ascending("a"), a=[3.0])
    assert one(spark, V.is_strictly_ascending(F.filter("a", lambda x: x > 9)), a=[3.0])


def test_row_scaling_of_constant_row_is_null(spark):
    assert one(spark, V.range_scaled("a"), a=[2.0, 4.0]) == [1.0, 2.0]
    assert one(spark, V.range_shifted("a"), a=[2.0, 4.0]) == [0.0, 1.0]
    assert one(spark, V.range_scaled("a"), a=[3.0, 3.0]) == [None, None]


def test_sizes_must_match(spark):
    with pytest.raises(Exception, match="vector sizes differ"):
        one(spark, V.require_same_size("a", "b"), a=[1.0], b=[1.0, 2.0])


def test_draws_do_not_depend_on_partitioning(spark):
    draw = seeded.hashed(5)
    rows = spark.range(2000).select("id", draw(F.col("id"), F.lit(3)).alias("u"))
    again = spark.range(2000).repartition(7).select("id", draw(F.col("id"), F.lit(3)).alias("u"))
    first = {r["id"]: r["u"] for r in rows.collect()}
    assert first == {r["id"]: r["u"] for r in again.collect()}
    assert 0.47 < sum(first.values()) / 2000 < 0.53
    assert all(0 <= u < 1 for u in first.values())


def test_bernoulli_outside_unit_interval_is_zero(spark):
    draw = seeded.hashed(1)
    for p in (-0.5, 1.5):
        hits = spark.range(50).select(seeded.bernoulli(draw, "id", F.lit(0), p).alias("b")).agg(F.sum("b")).first()[0]
        assert hits == 0.0
    assert spark.range(50).select(seeded.bernoulli(draw, "id", F.lit(0), 1.0).alias("b")).agg(F.sum("b")).first()[0] == 50
