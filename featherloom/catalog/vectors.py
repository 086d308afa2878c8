"""Queries on the embedding vectors: projections, scaling, masks, functions, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import CELLS, draw_sql, long_form, query, r6, table, vectors
from featherloom.functions import activations, seeded, surfaces
from featherloom.functions import vectors as V
from featherloom.operators import distances, documents, joins, masks, metrics, scaling
from featherloom.sources import samples

MASK_SEED, NOISE_SEED, DROP_SEED, SAMPLE_SEED = 11, 23, 37, 53


@query(
    f"""
WITH {CELLS}, r AS (SELECT id, max(x) - min(x) AS range FROM cells GROUP BY id)
SELECT c.id, c.pos, round(c.x / r.range, 6) + 0.0 AS value FROM cells c JOIN r ON c.id = r.id"""
)
def row_range_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir).withColumn("s", V.range_scaled("features")), "s", "id")


@query(
    f"""
WITH {CELLS}, r AS (SELECT id, max(x) - min(x) AS range FROM cells GROUP BY id)
SELECT c.id, c.pos, round((c.x - r.range) / r.range, 6) + 0.0 AS value FROM cells c JOIN r ON c.id = r.id"""
)
def row_range_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir).withColumn("s", V.range_shifted("features")), "s", "id")


@query(
    f"""
WITH {CELLS}, labelled AS (
  SELECT id, pos + 1 AS pos, x FROM cells UNION ALL SELECT vec_id, 0, CAST(label AS DOUBLE) FROM embeddings
), e AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM labelled GROUP BY pos)
SELECT l.id, l.pos, round((l.x - e.lo) / (e.hi - e.lo), 6) + 0.0 AS value
FROM labelled l JOIN e ON l.pos = e.pos"""
)
def column_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and features scaled together."""
    rows = vectors(spark, sf_dir).withColumn("all", F.concat(F.array(F.col("label").cast("double")), "features"))
    return long_form(scaling.column_minmax(rows, "all", "scaled"), "scaled", "id")


@query(f"WITH {CELLS} SELECT pos, round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi FROM cells GROUP BY pos")
def column_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scaling.column_extent(vectors(spark, sf_dir), "features")
    cells = found.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "e"))
    return cells.select(F.col("pos").cast("bigint").alias("pos"), r6("e.lo").alias("lo"), r6("e.hi").alias("hi"))


@query(f"WITH {CELLS} SELECT id, round(max(x), 6) + 0.0 AS top, round(min(x), 6) + 0.0 AS bottom FROM cells GROUP BY id")
def row_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(
        "id", r6(F.array_max("features")).alias("top"), r6(F.array_min("features")).alias("bottom")
    )


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = seeded.modular(MASK_SEED)
    return vectors(spark, sf_dir).withColumn("features", masks.zero_mask("features", "id", 0.3, draw))


MASKED_CELLS = f"""{CELLS}, masked AS (
  SELECT id, label, pos, CASE WHEN {draw_sql('id', 'pos', MASK_SEED)} >= 0.3 THEN x ELSE 0.0 END AS x FROM cells
)"""


@query(f"WITH {MASKED_CELLS} SELECT id, pos, round(x, 6) + 0.0 AS value FROM masked")
def zero_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(masked(spark, sf_dir), "features", "id")


@query(f"WITH {MASKED_CELLS} SELECT id, pos, round(x, 6) + 0.0 AS value FROM masked WHERE x <> 0")
def dense_to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = masked(spark, sf_dir).select("id", F.inline(V.to_entries("features")))
    return entries.select("id", F.col("idx").cast("bigint").alias("pos"), r6("val").alias("value"))


@query(f"WITH {MASKED_CELLS} SELECT id, pos, round(x, 6) + 0.0 AS value FROM masked")
def sparse_to_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked vectors as entries, filled up to their fixed width again."""
    entries = masked(spark, sf_dir).select("id", V.to_entries("features").alias("entries"))
    return long_form(entries, V.from_entries("entries", 64), "id")


@query(f"WITH {MASKED_CELLS} SELECT max(pos) + 1 AS features FROM masked WHERE x <> 0")
def feature_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masked(spark, sf_dir).select(F.transform(V.to_entries("features"), lambda e: e["idx"]).alias("indices"))
    return documents.feature_count(rows).select(F.col("features").cast("bigint").alias("features"))


@query(
    f"""WITH {MASKED_CELLS} SELECT id, CASE WHEN id % 3 = 0 THEN count(*) FILTER (WHERE x <> 0) < 2 ELSE true END AS ascending
FROM masked GROUP BY id"""
)
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of every third row are turned round first."""
    indices = F.transform(V.to_entries("features"), lambda e: e["idx"])
    indices = F.when(F.col("id") % 3 == 0, F.reverse(indices)).otherwise(indices)
    return masked(spark, sf_dir).select("id", V.is_strictly_ascending(indices).alias("ascending"))


@query(
    f"""
WITH {CELLS} SELECT id, pos, round(x, 6) + 0.0 AS value FROM cells
UNION ALL SELECT vec_id, len(embedding), 1.0 FROM embeddings"""
)
def append_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir), V.append_one("features"), "id")


@query(
    f"""
WITH {CELLS} SELECT id, pos + 1 AS pos, round(x, 6) + 0.0 AS value FROM cells
UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings"""
)
def prepend_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir), V.prepend_one("features"), "id")


@query(f"WITH {CELLS} SELECT id, pos - 1 AS pos, round(x, 6) + 0.0 AS value FROM cells WHERE pos > 0")
def drop_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir), V.drop_first("features"), "id")


@query(
    """
SELECT vec_id AS id, CAST(label AS DOUBLE) AS first_output, label * CAST(0.5 AS DOUBLE) + 2 AS second_output
FROM embeddings"""
)
def two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("label").cast("double")
    pair = vectors(spark, sf_dir).select("id", F.array(y, y * 0.5 + 2.0).alias("y"))
    return pair.select("id", F.col("y")[0].alias("first_output"), F.col("y")[1].alias("second_output"))


@query(f"WITH {CELLS} SELECT id, pos, ceil(x * 10) / 10 + 0.0 AS value FROM cells")
def round_up_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = vectors(spark, sf_dir).select("id", F.posexplode("features").alias("pos", "x"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), (V.ceil_to_tenth("x") + 0.0).alias("value"))


@query(
    f"""
WITH {CELLS} SELECT id, pos, CASE WHEN x > 0 AND {draw_sql('id', 'pos', NOISE_SEED)} < 0.7
  THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM cells"""
)
def binary_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform("features", lambda x: (x > 0).cast("double"))
    noisy = masks.binary_corruption(bits, "id", 0.3, seeded.modular(NOISE_SEED))
    return long_form(vectors(spark, sf_dir), noisy, "id")


@query(
    f"""
WITH {CELLS}, m AS (SELECT *, CASE WHEN {draw_sql('id', 'pos', DROP_SEED)} > 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS mask FROM cells)
SELECT id, pos, mask, round(x * mask, 6) + 0.0 AS value FROM m"""
)
def dropout_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors(spark, sf_dir).select(
        "id", masks.dropout_train("features", "id", 0.25, seeded.modular(DROP_SEED)).alias("d")
    )
    cells = both.select("id", F.posexplode(F.arrays_zip("d.mask", "d.masked")).alias("pos", "c"))
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("c.mask").alias("mask"), r6("c.masked").alias("value"))


@query(f"WITH {CELLS} SELECT id, pos, round(x * 0.75, 6) + 0.0 AS value FROM cells")
def dropout_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir), masks.dropout_test("features", 0.25), "id")


@query(
    f"""
WITH {CELLS}, units AS (SELECT unnest(range(3)) AS unit),
z AS (
  SELECT c.id, u.unit, sum(c.x * ((u.unit * 17 + c.pos * 31) % 101 - 50) / 500.0) AS z
  FROM cells c, units u GROUP BY c.id, u.unit
)
SELECT id, unit, round(1 / (1 + exp(-z)), 6) + 0.0 AS probability,
       CASE WHEN {draw_sql('id', 'unit', SAMPLE_SEED)} < 1 / (1 + exp(-z)) THEN 1.0 ELSE 0.0 END::DOUBLE AS sample
FROM z"""
)
def bernoulli_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden units drawn from their activation probability."""
    draw = seeded.modular(SAMPLE_SEED)
    parts = []
    for unit in range(3):
        weights = F.array(*[F.lit(((unit * 17 + p * 31) % 101 - 50) / 500.0) for p in range(64)])
        p = activations.sigmoid(V.dot(weights, "features"))
        parts.append(F.struct(F.lit(unit).cast("bigint").alias("unit"), p.alias("p")))
    units = vectors(spark, sf_dir).select("id", F.inline(F.array(*parts)))
    return units.select("id", "unit", r6("p").alias("probability"), seeded.bernoulli(draw, "id", "unit", "p").alias("sample"))


KIND = "CASE WHEN bool_and({x} IN (0, 1)) THEN 'binary' WHEN min({x}) >= 0 AND max({x}) <= 1 THEN 'real01' ELSE 'real' END"


@query(
    f"""WITH {CELLS} SELECT {KIND.format(x='x')} AS kind,
  {KIND.format(x='CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END')} AS kind_of_bits,
  {KIND.format(x='least(abs(x), 1.0)')} AS kind_of_shares FROM cells"""
)
def input_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of the vectors, of their signs and of their sizes cut at 1."""
    rows = vectors(spark, sf_dir).select(
        "features",
        F.transform("features", lambda x: (x > 0).cast("double")).alias("bits"),
        F.transform("features", lambda x: F.least(F.abs(x), F.lit(1.0))).alias("shares"),
    )
    kinds = {name: metrics.input_kind(rows, column) for name, column in (("kind_of_bits", "bits"), ("kind_of_shares", "shares"))}
    return metrics.input_kind(rows, "features").withColumns({name: kind.scalar() for name, kind in kinds.items()})


@query(
    f"""
WITH {CELLS}, a AS (SELECT id, pos, 1 / (1 + exp(-x)) AS s, 1.7159::DOUBLE * tanh(x * 2 / 3) AS t FROM cells)
SELECT id, pos, round(s, 6) + 0.0 AS sigm, round(s * (1 - s), 6) + 0.0 AS sigm_slope,
       round(t, 6) + 0.0 AS tanh_opt,
       round(1.7159::DOUBLE * 2 / 3 * (1 - t * t / (1.7159::DOUBLE * 1.7159::DOUBLE)), 6) + 0.0 AS tanh_slope
FROM a"""
)
def activation_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = vectors(spark, sf_dir).select("id", F.posexplode("features").alias("pos", "x"))
    cells = cells.select(
        "id", F.col("pos").cast("bigint").alias("pos"), activations.sigmoid("x").alias("s"), activations.scaled_tanh("x").alias("t")
    )
    return cells.select(
        "id",
        "pos",
        r6("s").alias("sigm"),
        r6(activations.sigmoid_slope("s")).alias("sigm_slope"),
        r6("t").alias("tanh_opt"),
        r6(activations.scaled_tanh_slope("t")).alias("tanh_slope"),
    )


@query(
    f"""
WITH {CELLS}, m AS (SELECT id, max(x) AS top FROM cells GROUP BY id),
e AS (SELECT c.id, c.pos, exp(c.x - m.top) AS e FROM cells c JOIN m ON c.id = m.id)
SELECT id, pos, round(e / sum(e) OVER (PARTITION BY id), 6) + 0.0 AS value FROM e"""
)
def vector_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir), activations.softmax_all("features"), "id")


@query(
    """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN d > 0 THEN d + ln(1 + exp(-d)) ELSE ln(1 + exp(d)) END, 6) + 0.0 AS value
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 100.0 - 500 AS d FROM lineitem)"""
)
def log1p_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_extendedprice") / 100.0 - 500.0
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(activations.log1p_exp(d)).alias("value")
    )


CENTRES = f"""{CELLS}, centres AS (SELECT label, pos, avg(x) AS c FROM cells GROUP BY label, pos)"""


@query(
    f"""
WITH {CENTRES}
SELECT v.id, round(sum((v.x - k.c) * (v.x - k.c)), 6) + 0.0 AS exact,
       round(sum((v.x - k.c) * (v.x - k.c)), 6) + 0.0 AS by_norms, round(sum(v.x * k.c), 6) + 0.0 AS dot
FROM cells v JOIN centres k ON v.label = k.label AND v.pos = k.pos GROUP BY v.id"""
)
def squared_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the mean vector of its label, exact and by norms."""
    rows = vectors(spark, sf_dir)
    centres = metrics.mean_vector(rows, "features", "centre", ["label"])
    centres = centres.withColumn("centre_norm", F.sqrt(V.squared_norm("centre")))
    with_norm = rows.withColumn("norm", F.sqrt(V.squared_norm("features")))
    paired = joins.join_skewed(with_norm, centres, "label", ["id"])
    return paired.select(
        "id",
        r6(V.squared_distance("features", "centre")).alias("exact"),
        r6(V.squared_distance_by_norms("features", "centre", "norm", "centre_norm")).alias("by_norms"),
        r6(V.dot("features", "centre")).alias("dot"),
    )


@query(
    f"""
WITH {CELLS}, nxt AS (SELECT id, pos, x, lead(x) OVER (PARTITION BY id ORDER BY pos) AS y FROM cells)
SELECT id,
       round(sum(100 * (y - x * x) * (y - x * x) + (x - 1) * (x - 1)), 6) + 0.0 AS rosenbrock,
       round(sum(x * x - 10 * cos(2 * pi() * x) + 10), 6) + 0.0 AS rastrigin,
       round(sum(x * x), 6) + 0.0 AS sphere
FROM (SELECT id, x, y FROM nxt) GROUP BY id"""
)
def test_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["rosenbrock", "rastrigin", "sphere"]
    return vectors(spark, sf_dir).select("id", *[r6(surfaces.surface(n, "features")).alias(n) for n in names])


@query(
    f"""
WITH ids AS (SELECT p_partkey AS id FROM part), slots AS (SELECT unnest(range(5)) AS pos),
x AS (SELECT id, pos, {draw_sql('id', 'pos', 71)} * 20 - 10 AS x FROM ids, slots)
SELECT id, pos, round(x, 6) + 0.0 AS value, round(sum(x * x) OVER (PARTITION BY id), 6) + 0.0 AS y FROM x"""
)
def random_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sphere sample per part, from reproducible draws."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    rows = samples.samples_for(ids, "id", 5, -10.0, 10.0, "sphere", seeded.modular(71))
    return long_form(rows.withColumn("y", r6("y")), "x", "id", "y")


@query(
    f"""
WITH {CELLS}, s AS (SELECT id, pos, x, 1 / (1 + exp(-x)) AS a FROM cells)
SELECT id, pos, round(x + a, 6) + 0.0 AS added, round(x - a, 6) + 0.0 AS subtracted,
       round(x * a, 6) + 0.0 AS multiplied, round(x * 2.5, 6) + 0.0 AS scaled FROM s"""
)
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("a", activations.sigmoid_all("features"))
    cells = rows.select(
        "id",
        F.posexplode(
            F.arrays_zip(
                V.add("features", V.require_same_size("a", "features")).alias("added"),
                V.subtract("features", "a").alias("subtracted"),
                V.multiply("features", "a").alias("multiplied"),
                V.scale("features", 2.5).alias("scaled"),
            )
        ).alias("pos", "c"),
    )
    names = ["added", "subtracted", "multiplied", "scaled"]
    return cells.select("id", F.col("pos").cast("bigint").alias("pos"), *[r6(f"c.{n}").alias(n) for n in names])


@query(
    """
SELECT event_id, round(exp(value / 100), 6) + 0.0 AS e, round(ln(1 + value), 6) + 0.0 AS l,
       round(pow(value, 1.5), 4) + 0.0 AS p, CAST(ceil(value) AS BIGINT) AS c, abs(value - 50) AS a,
       greatest(value, 10.0) AS g, trim(' ' || event_type || ' ') AS t, starts_with(event_type, 'c') AS s
FROM events"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        r6(F.exp(v / 100)).alias("e"),
        r6(F.ln(1 + v)).alias("l"),
        (F.round(F.pow(v, 1.5), 4) + 0.0).alias("p"),
        F.ceil(v).alias("c"),
        F.abs(v - 50).alias("a"),
        F.greatest(v, F.lit(10.0)).alias("g"),
        F.trim(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("t"),
        F.startswith("event_type", F.lit("c")).alias("s"),
    )


@query(
    f"""
WITH {CELLS}, centres AS MATERIALIZED (SELECT label AS centre, pos, avg(x) AS c FROM cells GROUP BY label, pos),
pairs AS (
  SELECT v.id, k.centre, sum((v.x - k.c) * (v.x - k.c)) AS d FROM cells v JOIN centres k ON v.pos = k.pos GROUP BY v.id, k.centre
), placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, centre) AS place FROM pairs)
SELECT id, centre AS nearest, round(d, 6) + 0.0 AS distance FROM placed WHERE place = 1"""
)
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the label whose mean vector is closest, and how far it is."""
    rows = vectors(spark, sf_dir)
    centres = metrics.mean_vector(rows, "features", "vector", ["label"]).withColumnRenamed("label", "centre")
    found = distances.nearest_centre(rows.select("id", "features"), centres)
    return found.select("id", "nearest", r6("distance").alias("distance"))
