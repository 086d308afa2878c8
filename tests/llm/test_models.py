"""Language scores and language labels: brute force, slopes, normalisation, held-out results."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from featherloom.llm import language_id, lm

from ..conftest import SF_SMALL
from .rows import ODD, docs, empty

SMALL = lm.LmSettings(words=30, classes=10, dictionary=60, width=8)


def held(i, remainder):
    return i is None or zlib.crc32(str(i).encode()) % 5 == remainder


def test_crc_of_the_id(spark):
    rows = [(k,) for k in (*range(200), 10**12, -5, None)]
    frame = spark.createDataFrame(rows, "doc_id long").select("doc_id", language_id.held_out("doc_id", 1).alias("h"))
    assert all(r["h"] == held(r["doc_id"], 1) for r in frame.collect())


def check_base(rows, got):
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i, 1):
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10(counts[x] + 0.5) for x in w) + math.log10(ends + 0.5) - (len(w) + 1) * math.log10(n + 0.5 * (v + 1))
        want.append((i, held(i, 1), len(w) + 1, sum(x in counts for x in w) + (ends > 0), n, round(base, 6)))
    assert sorted(want, key=str) == sorted(((*r[:5], round(r[5], 6)) for r in got), key=str)


def test_base_scores_of_odd_documents(spark):
    rows = [*ODD, *((100 + k, f"the same old words and a rare{k} one") for k in range(60))]
    got = lm.score_documents(docs(spark, rows), language_id.held_out("doc_id", 1), SMALL).collect()
    check_base(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 9}
    assert len(same) == 1


def test_without_training_documents(spark):
    rows = [(i, t) for i, t in ODD if held(i, 1)]
    got = lm.score_documents(docs(spark, rows), language_id.held_out("doc_id", 1), SMALL).collect()
    check_base(rows, got)
    assert lm.score_documents(empty(spark), language_id.held_out("doc_id", 1), SMALL).count() == 0


def test_network_beats_the_base_on_held_out_texts(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = lm.score_documents(table, language_id.held_out("doc_id", 1)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_normalisers_are_sums_over_all_types():
    network = lm.LogBilinear(np.array([5.0, 3.0, 2.0, 9.0]), 3, 1)
    network.w["bias"] += 0.3
    one, two = network.tables()
    whole = np.exp(one[:, None, :] + two[None, :, :] + network.w["bias"][0]).sum(axis=2)
    assert np.allclose(network.normalisers(), np.log(whole), atol=1e-4)


def test_noise_contrast_learns_an_order():
    draw = np.random.default_rng(0)
    types = np.empty(40_000, np.int64)
    state = 0
    for k in range(len(types)):
        state = (state + 1) % 5 if draw.random() < 0.9 else int(draw.integers(5))
        types[k] = state
    network = lm.LogBilinear(np.bincount(types, minlength=5).astype(float), 6, 2)
    c1, c2 = lm.contexts(types, np.array([len(types)]), 5)
    for turn in range(3):
        network.fit(c1, c2, types, lm.LmSettings(), turn)
    one, two = network.tables()
    log = one[c1, types] + two[c2, types] + network.w["bias"][0][types] - network.normalisers()[c1, c2]
    assert log.mean() > -0.9 > -np.log(5)


def test_contexts_start_anew_with_each_text():
    c1, c2 = lm.contexts(np.array([1, 2, 3, 9, 4, 9, 9]), np.array([4, 2, 1]), 50)
    assert c1.tolist() == [50, 1, 2, 3, 50, 4, 50] and c2.tolist() == [50, 50, 1, 2, 50, 50, 50]


# Languages.

NET = language_id.LanguageSettings(embedding=3, hidden=4, epochs=2)


def test_slopes_of_backpropagation_through_time():
    network = language_id.ByteNetwork(["a", "b", "c"], NET, seed=1)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    draw = np.random.default_rng(0)
    data = draw.integers(97, 101, (6, 5)).astype(np.uint8)
    target = draw.dirichlet([1, 1, 1], 6)
    weight = draw.random(6) + 0.5
    _, grad = network.gradient(data, target, weight)
    for name, value in network.w.items():
        flat = value.reshape(-1)
        places = [97 * 3, 98 * 3 + 1] if name == "embed" else draw.integers(0, len(flat), 3).tolist()
        for k in places:
            old = flat[k]
            flat[k] = old + 1e-3
            up, _ = network.gradient(data, target, weight)
            flat[k] = old - 1e-3
            down, _ = network.gradient(data, target, weight)
            flat[k] = old
            assert abs((up - down) / 2e-3 - np.asarray(grad[name]).reshape(-1)[k]) < 2e-4, name


def test_every_position_has_a_distribution_and_sums_pool_them():
    network = language_id.ByteNetwork(["a", "b"], NET)
    runs = [b"abc", "über".encode(), b"abc", b"x"]
    sums = network.sums(runs)
    assert np.allclose(sums[:, :2].sum(axis=1), [3, 5, 3, 1], atol=1e-4) and sums[:, 2].tolist() == [3, 5, 3, 1]
    assert np.allclose(sums[0], sums[2])
    table = language_id.WordSums(network)
    pooled = table.pooled([b"abc, x 12", b"", b"!! abc"])
    assert np.allclose(pooled[0], sums[0] + sums[3], atol=1e-4) and not pooled[1].any() and np.allclose(pooled[2], sums[0], atol=1e-4)
    table.most = 1
    assert np.allclose(table.pooled([b"abc, x 12", b"abc, q"])[0], pooled[0], atol=1e-4)


def test_long_runs_are_cut_but_not_dropped():
    runs = language_id.letter_runs("A" * 60 + "1b_ç", 24)
    assert [len(r) for r in runs] == [24, 24, 12, 1, 2]


def test_marks_are_read_and_pieces_end_between_characters():
    assert language_id.letter_runs("हिन्दी भाषा, E\u0301t\u0301 \ufe0f") == [x.encode() for x in ("हिन्दी", "भाषा", "e\u0301t\u0301")]
    text = "भाषा" * 30
    pieces = language_id.letter_runs(text, 25)
    assert max(map(len, pieces)) <= 25 and "".join(p.decode() for p in pieces) == text


def test_long_runs_are_read_whole(monkeypatch):
    network = language_id.ByteNetwork(["a", "b"], NET)
    text = "überlanges" * 7
    whole = network.probabilities(np.frombuffer(text.encode(), np.uint8)[None]).sum(axis=0)[0]
    monkeypatch.setattr(language_id, "STEPS", 16)
    for got in (network.sums([text.encode()])[0], language_id.WordSums(network).pooled([text.encode()])[0]):
        assert got[2] == len(text.encode()) and np.allclose(got[:2], whole, rtol=1e-5)


def test_every_language_is_learned(spark, monkeypatch):
    names = [f"l{k:03}" for k in range(300)]
    rows = [(k, chr(97 + k % 26) * (2 + k // 26), names[k % 300]) for k in range(3000) if not held(k, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = language_id.ByteNetwork.fit

    def watched(self, runs, shares, weight):
        seen.extend(k for s in shares for k in s)
        return fit(self, runs, shares, weight)

    monkeypatch.setattr(language_id.ByteNetwork, "fit", watched)
    network = language_id.train(table, language_id.LanguageSettings(embedding=3, hidden=4, epochs=1, runs=20))
    assert network.languages == names and {names[k] for k in seen} == set(names)


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    network = language_id.train(table)
    got = table.join(language_id.predict(table, network), "doc_id").where(language_id.held_out())
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    assert got.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_odd_documents(spark):
    table = docs(spark, [(k, f"the cat and dog of text {k}") for k in range(40)]).unionByName(docs(spark, [(100 + k, "der hund und die katze") for k in range(40)], "de"))
    network = language_id.train(table, language_id.LanguageSettings(epochs=3))
    rows = language_id.predict(docs(spark, ODD), network).collect()
    assert len(rows) == len(ODD)
    none = {i for i, t in ODD if not any(c.isalpha() for c in t or "")}
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und" and r["score"] == 0) == (r["doc_id"] in none)
    unlearned = language_id.train(docs(spark, ODD, lang=None))
    assert {r["lang_pred"] for r in language_id.predict(docs(spark, ODD), unlearned).collect()} == {"und"}
    assert language_id.predict(empty(spark), network).count() == 0
