import random

import pytest
from pyspark.sql import functions as F

from featherloom.functions import seeded
from featherloom.operators import documents, joins, masks, metrics, order, pairs, scaling, splits


def skewed_rows(spark, n=4000):
    """A third of all rows belong to key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("k"), F.col("id").alias("x")
    )


def test_hot_key_is_found_and_split(spark):
    rows = skewed_rows(spark)
    hot = joins.find_hot(joins.count_keys(rows, "k"), "k", pieces=30, floor=100)
    found = hot.table.collect()
    assert [(r["k"], r["salts"]) for r in found] == [(0, 11)]
    salted = hot.salt(rows, ["x"], "s").where("k = 0").groupBy("s").count().collect()
    assert len(salted) == 11 and max(r["count"] for r in salted) < 200


def test_no_hot_keys_below_the_floor(spark):
    assert joins.find_hot(joins.count_keys(skewed_rows(spark), "k"), "k").table is None


def test_number_of_hot_keys_is_bounded(spark):
    rows = spark.range(5000).select((F.col("id") % 50).alias("k"))
    hot = joins.find_hot(joins.count_keys(rows, "k"), "k", pieces=60, floor=0)
    assert hot.table.count() < 60


@pytest.mark.parametrize("floor", [0, 10**9])
def test_skewed_join_equals_plain_join(spark, floor):
    rows = skewed_rows(spark)
    per_key = spark.range(80).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    got = joins.join_skewed(rows, per_key, "k", ["x"], pieces=30, floor=floor).select("k", "x", "y")
    plain = rows.join(per_key, "k").select("k", "x", "y")
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    kept = joins.keep_keys(rows, per_key, "k", ["x"], floor=floor).select("k", "x")
    assert kept.count() == plain.count()


@pytest.mark.parametrize("span,floor", [(3, 50), (50, 50), (10**6, 50), (10, 10**6)])
def test_consecutive_pairs(spark, span, floor):
    rng = random.Random(7)
    data = [(0 if rng.random() < 0.4 else rng.randrange(5), k, float(rng.randrange(100))) for k in range(300)]
    rows = spark.createDataFrame(data, "u INT, t INT, v DOUBLE")
    got = {(r["u"], r["t"]): (r["previous"], r["current"]) for r in pairs.consecutive_pairs(rows, "u", "t", "v", span, floor).collect()}
    expected, last = {}, {}
    for u, t, v in data:
        if u in last:
            expected[(u, t)] = (last[u], v)
        last[u] = v
    assert got == expected


def triples(spark, rows):
    return spark.createDataFrame(rows, "doc INT, col INT, value DOUBLE")


def test_softmax_drops_documents_that_overflow(spark):
    rows = triples(spark, [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 710.0), (2, 2, 1.0), (3, 5, 709.0)])
    got = {(r["doc"], r["col"]): r["value"] for r in scaling.document_softmax(rows).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 5)}
    assert got[(1, 1)] + got[(1, 2)] == pytest.approx(1.0)
    stable = {(r["doc"], r["col"]): r["value"] for r in scaling.document_softmax(rows, stable=True).collect()}
    assert stable[(2, 1)] == pytest.approx(1.0)
    assert len(stable) == 5


def test_softmax_counts_documents_it_cannot_express(spark):
    # Each value is in range, the sum of three is not.
    rows = triples(spark, [(1, 1, 1.0), (2, 1, 710.0), (3, 1, 709.0), (3, 2, 709.0), (3, 3, 709.0)])
    assert {r["doc"] for r in scaling.document_softmax(rows).collect()} == {1}
    assert tuple(scaling.left_out(rows).first()) == (3, 2)
    stable = {(r["doc"], r["col"]): r["value"] for r in scaling.document_softmax(rows, stable=True).collect()}
    assert stable[(3, 1)] == pytest.approx(1 / 3)


def test_grouped_documents_are_bounded_sorted_and_complete(spark):
    data = [(d, c, float(d * c)) for d in (1, 2) for c in range(25, 0, -1)] + [(1, 7, 100.0)]
    parts = documents.group_documents(triples(spark, data), part_width=10)
    rows = documents.sorted_by_document(parts).collect()
    assert all(len(r["words"]) <= 10 for r in rows)
    for doc in (1, 2):
        cols = [w["col"] for r in rows if r["doc"] == doc for w in r["words"]]
        assert cols == list(range(1, 26))
    back = {(r["doc"], r["col"]): r["value"] for r in documents.ungroup_documents(parts).collect()}
    assert back[(1, 7)] == 107.0 and len(back) == 50


def test_sparse_vectors(spark):
    parts = documents.group_documents(triples(spark, [(1, 1, 2.0), (1, 3, 4.0), (2, 2, 5.0)]))
    zero_based = {r["doc"]: r["features"] for r in documents.sparse_vectors(parts, 3).collect()}
    assert zero_based[1].toArray().tolist() == [2.0, 0.0, 4.0]
    kept = {r["doc"]: r["features"] for r in documents.sparse_vectors(parts, 4, keep_slot0=True).collect()}
    assert kept[2].toArray().tolist() == [0.0, 0.0, 5.0, 0.0]


def test_extent_and_stats(spark):
    rows = triples(spark, [(5, 9, 1.0), (5, 2, 1.0), (3, 4, 1.0)])
    assert documents.matrix_extent(rows).first().asDict() == {"rows": 5, "cols": 9, "entries": 3}
    assert documents.dataset_stats(rows).first().asDict() == {"docs": 2, "cols": 9}


def test_splits_are_disjoint_complete_and_stable(spark):
    rows = spark.range(3000)
    parts = splits.random_split(rows, "id", [0.3, 0.3, 0.4], seeded.hashed(1))
    ids = [set(r["id"] for r in p.collect()) for p in parts]
    assert sum(map(len, ids)) == 3000 and len(set().union(*ids)) == 3000
    again = splits.random_split(rows.repartition(13), "id", [0.3, 0.3, 0.4], seeded.hashed(1))
    assert [set(r["id"] for r in p.collect()) for p in again] == ids
    assert abs(len(ids[2]) - 1200) < 150


def test_folds_cover_every_row_once(spark):
    rows = spark.range(1000)
    seen = []
    for train, valid in splits.k_fold(rows, "id", 4, seeded.hashed(2)):
        t, v = {r["id"] for r in train.collect()}, {r["id"] for r in valid.collect()}
        assert not t & v and len(t | v) == 1000
        seen += v
    assert sorted(seen) == list(range(1000))


def test_bad_split_arguments():
    with pytest.raises(ValueError):
        splits.split_column("id", [], seeded.hashed(1))
    with pytest.raises(ValueError):
        splits.fold_column("id", 1, seeded.hashed(1))
    with pytest.raises(ValueError):
        splits.batch_column("id", 0, seeded.hashed(1))


def test_shuffle_keeps_all_rows(spark):
    rows = spark.range(500)
    got = [r["id"] for r in order.shuffled(rows, "id", seeded.hashed(3)).collect()]
    assert sorted(got) == list(range(500)) and got != list(range(500))
    part = [r["id"] for r in order.shuffled(rows, "id", seeded.hashed(3), share=0.2).collect()]
    rest = part[len([i for i in part]) - 350 :]
    assert sorted(part) == list(range(500)) and rest == sorted(rest)


def test_masks(spark):
    rows = spark.range(400).select("id", F.array_repeat(F.lit(1.0), 10).alias("x"))
    draw = seeded.hashed(4)

    def share(column):
        return rows.select(F.explode(column).alias("v")).agg(F.avg("v")).first()[0]

    assert share(masks.zero_mask("x", "id", 0.3, draw)) == pytest.approx(0.7, abs=0.05)
    assert share(masks.binary_corruption("x", "id", 0.3, draw)) == pytest.approx(0.7, abs=0.05)
    assert share(masks.dropout_mask("x", "id", 0.4, draw)) == pytest.approx(0.6, abs=0.05)
    assert share(masks.dropout_test("x", 0.4)) == pytest.approx(0.6)
    zero = rows.select(F.transform("x", lambda v: v * 0.0).alias("x"), "id")
    assert zero.select(F.explode(masks.binary_corruption("x", "id", 0.0, draw)).alias("v")).agg(F.max("v")).first()[0] == 0.0
    with pytest.raises(ValueError):
        masks.zero_mask("x", "id", 1.5, draw)


def test_error_rate_and_roc(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.1), (1.0, 0.0, 0.4), (0.0, 0.0, 0.35), (1.0, 1.0, 0.8)], "label DOUBLE, predicted DOUBLE, score DOUBLE")
    got = metrics.error_rate(rows).first()
    assert got["error_rate"] == 0.25 and got["accuracy"] == 0.75 and got["rows"] == 4
    assert metrics.area_under_roc(rows) == pytest.approx(1.0)
    tied = rows.withColumn("score", F.lit(0.5))
    assert metrics.area_under_roc(tied) == pytest.approx(0.5)


def test_input_kind(spark):
    def kind(*arrays):
        return metrics.input_kind(spark.createDataFrame([(a,) for a in arrays], "f ARRAY<DOUBLE>"), "f").first()["kind"]

    assert kind([0.0, 1.0], [1.0, 1.0]) == "binary"
    assert kind([0.0, 0.5], [1.0, 1.0]) == "real01"
    assert kind([0.0, 0.5], [1.0, -1.0]) == "real"


def test_divergences(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k STRING, w DOUBLE")
    same = metrics.divergences(make(("a", 1.0), ("b", 3.0)), make(("a", 2.0), ("b", 6.0)), "k", "w").first()
    assert same["symmetric_kl"] == pytest.approx(0.0)
    gone = metrics.divergences(make(("a", 1.0), ("b", 3.0)), make(("a", 2.0)), "k", "w").first()
    assert gone["kl_pq"] is None and gone["kl_qp"] is not None


def test_unmatched_documents_fail(spark):
    a, b = triples(spark, [(1, 1, 1.0)]), triples(spark, [(1, 2, 1.0)])
    with pytest.raises(Exception, match="unmatched cell"):
        metrics.aligned_difference(a, b).collect()


def test_label_helpers(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 5)], "doc INT, label INT")
    shifted = rows.withColumn("label", joins.shifted_label("label"))
    assert [r["doc"] for r in metrics.illegal_labels(shifted).collect()] == [3]


def test_words_are_counted_without_a_shuffle_and_repeated_ids_together(spark):
    texts = [(1, "b a  b\ta"), (2, " "), (3, None), (4, "b"), (4, "b c"), (5, "a"), (None, "x"), (None, "x y")]
    rows = spark.createDataFrame(texts, "doc_id INT, text STRING")
    got = {(r["doc"], r["col"]): r["value"] for r in documents.term_triples(rows).collect()}
    assert got == {(1, "a"): 2.0, (1, "b"): 2.0, (4, "b"): 2.0, (4, "c"): 1.0, (5, "a"): 1.0, (None, "x"): 2.0, (None, "y"): 1.0}
    once = documents.term_triples(rows.where("doc_id < 4"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stable", [False, True])
def test_softmax_of_rows_equals_that_of_triples(spark, stable):
    texts = [(1, "b a b"), (2, ""), (3, "w " * 800 + "v"), (4, "b"), (4, "b c"), (None, "x")]
    rows = spark.createDataFrame(texts, "doc_id INT, text STRING")
    found = scaling.softmaxed_terms(*documents.term_rows(rows), stable)
    wanted = scaling.document_softmax(documents.term_triples(rows), stable)
    got, expected = ({(r["doc"], r["col"]): r["value"] for r in df.collect()} for df in (found, wanted))
    assert got.keys() == expected.keys() and ((3, "v") in got) == stable
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)
