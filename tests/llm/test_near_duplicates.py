"""MinHash, vector and component operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from featherloom.llm import components, minhash, vector_dedup
from featherloom.session import seal

from .rows import LONG, ODD, docs, empty


def roots(n, edges):
    up = list(range(n))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    edges = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                edges.append((b, a))
    top = roots(len(rows), edges)
    out = []
    for k, (doc, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if top[j] == top[k] and rows[j][0] is not None]
        component = (min(group) if group else None) if sets[k] else doc
        out.append((doc, len(sets[k]), component, doc == component))
    return sorted(out, key=str)


def found(spark, rows, settings=minhash.NearSettings()):
    got = minhash.near_duplicates(docs(spark, rows), settings).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)


def test_odd_documents(spark):
    assert found(spark, ODD) == brute(ODD)


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.keep_one(empty(spark)).count() == 0


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k] = f"new{rng.randrange(10**6)}"
    return w


def near_copies():
    """Chains of edits and a cloud of copies that share too little with each other."""
    rng = random.Random(4)
    rows = []
    for chain in range(6):
        w = [f"c{chain}w{k}" for k in range(100)]
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            w = edited(rng, w, 2)
    base = [f"base{k}" for k in range(120)]
    rows += [(len(rows) + k, " ".join(edited(rng, base, 3 + k % 6))) for k in range(80)]
    rows += [(len(rows) + k, f"some other text number {k} with words of its own {k} {k + 1} {k + 2}") for k in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [512, 7])
def test_no_link_is_lost_in_chains_and_clouds(spark, tile):
    rows = near_copies()
    assert found(spark, rows, minhash.NearSettings(tile=tile)) == brute(rows)


def test_keep_one_keeps_one_of_each_group_and_all_columns(spark):
    rows = near_copies() + [(1000, "one text twice in full length here"), (1000, "one text twice in full length here"), (1001, None)]
    table = docs(spark, rows)
    kept = minhash.keep_one(table)
    assert kept.columns == table.columns
    want = [doc for doc, _, _, kept in brute(rows) if kept]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_keep_one_of_repeated_ids_with_different_texts(spark):
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (2, "a b c d e f g")]
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_one(docs(spark, rows)).collect()) == [(1, "a b c d e f g"), (2, "h i j k l m n")]


def test_estimate_is_corrected_for_chance(spark):
    s = minhash.NearSettings()
    shingler = minhash.Shingler(s)
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 800, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8):
        cut = int(800 * share)
        a = np.unique(np.concatenate([common[:cut], rng.integers(0, 2**63, 800 - cut, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common[:cut], rng.integers(0, 2**63, 800 - cut, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pa, pb = (shingler.packed(shingler.minima(x)).tolist() for x in (a, b))
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(pa, pb)], "a array<bigint>, b array<bigint>")
        got = frame.select(minhash.estimate(F.col("a"), F.col("b"), s).alias("e")).first()["e"]
        assert abs(got - true) < 0.17
        packed = np.array([pa, pb], np.int64).view(np.uint64)
        assert minhash.likely_pairs(packed[:1], packed[1:], s)[0, 0] == (got * 100 >= s.least_percent)


def test_shared_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6000, n, dtype=np.uint64)) for n in (5, 3000, 4000, 1)]
    got = minhash.shared_sizes(sets[:2], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(500, 500 + k) for k in range(1, 40)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (3, None), (900, 899)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{500 + k: 500 for k in range(40)}, 899: 899, 900: 899}
    assert components.components(links.where("a < 0")).count() == 0


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("tiles", T.StringType())]
)


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = []
    for k in range(150):
        v = base[k % 12] + rng.standard_normal(16) * (0.25 if k % 3 else 0.02)
        rows.append((k, [float(np.float32(x)) for x in v], k % 4))
    rows += [(200 + k, rows[5][1], rows[5][2]) for k in range(20)]
    rows += [
        (300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] + [1.0] * 15, 1),
        (305, [None] + [1.0] * 15, 1), (306, rows[5][1], None), (307, [1e-38] * 16, 2), (308, [1e38] * 16, 2), (309, [1.0] * 3, 2),
        (5, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2]),
    ]
    return rows


@pytest.mark.parametrize("tile", [4096, 9])
def test_vectors_against_brute_force(spark, tile):
    rows = vectors()
    good = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        good.append((label, x / np.linalg.norm(x)) if ok else None)
    edges = [
        (b, a)
        for a in range(len(rows))
        for b in range(a)
        if good[a] and good[b] and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93
    ]
    top = roots(len(rows), edges)
    want = []
    for k, (vec, _, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if top[j] == top[k] and rows[j][0] is not None]
        want.append((vec, sum(k in e for e in edges), min(group), vec == min(group)))
    table = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = vector_dedup.near_duplicates(table, vector_dedup.VectorSettings(tile=tile)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_vectors_of_an_empty_table(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    unit = vector_dedup.unit_rows(rng.standard_normal((200, 24)) * rng.lognormal(0, 3, (200, 24)))
    q, scale, norm, error = vector_dedup.quantised(unit)
    assert np.abs(q).max() <= 127 and (q == np.rint(q)).all()
    about = (q @ q.T) * scale[:, None] * scale[None, :]
    bound = error[:, None] + norm[:, None] * error[None, :] + vector_dedup.ROUNDING
    assert (np.abs(unit @ unit.T - about) <= bound).all()


def test_wide_vectors_stay_inside_their_allowance():
    """Worst case of the float32 sum: all components large and of one sign."""
    assert vector_dedup.allowance(64) == vector_dedup.ROUNDING
    for width in (1040, 1041, 20_000, 100_000):
        q = np.full((2, width), 127, np.float32)
        q[1, ::3] = 126
        exact = float(q[0].astype(np.float64) @ q[1].astype(np.float64))
        size = np.linalg.norm(q[0].astype(np.float64)) * np.linalg.norm(q[1].astype(np.float64))
        assert abs(float(q[0] @ q[1]) - exact) / size <= vector_dedup.allowance(width)
