"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from featherloom.llm import lexical

from .rows import ODD, docs, empty, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top=10):
    told = [(doc, Counter(terms(text))) for doc, text in rows]
    told = [(doc, t) for doc, t in told if t]
    n_docs, n_terms = len(told), sum(sum(t.values()) for _, t in told)
    df = Counter(x for _, t in told for x in t)
    out = []
    for item, text in items:
        scored = []
        for doc, t in told:
            m = 10 + (90 * sum(t.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t[x]) // (1000 * t[x] + 8 * m))
                for x in set(terms(text))
                if x in t
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda s: s[:3])
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:top])]
    return sorted(out, key=str)


def check(spark, rows, items, top=10):
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, terms string")
    got = lexical.search(docs(spark, rows), asked, top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == brute(rows, items, top)
    return found


def test_terms_stop_at_text_borders():
    texts = ["Ab-c9", "", "Éa b", "x", "yz ", None, "!?", "a\x00b\x7fc"]
    owner, found = lexical.terms_of(pa.array([t or "" for t in texts]).slice(0))
    want = [(k, t.encode()) for k, text in enumerate(texts) for t in terms(text)]
    assert list(zip(owner.tolist(), found.to_pylist())) == want
    owner, found = lexical.terms_of(pa.array(["zz", *[t or "" for t in texts]]).slice(1))
    assert list(zip(owner.tolist(), found.to_pylist())) == want


def test_odd_documents(spark):
    items = [(1, "alpha BETA gamma, hello!"), (2, None), (3, " .. "), (4, words(30)), (4, "word"), (None, "12 34 text"), (5, "nothing of it")]
    check(spark, ODD, items)


@pytest.mark.parametrize("seed,bucket", [(1, 2048), (2, 7), (3, 1)])
def test_random_texts(spark, seed, bucket, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]

    def text(n):
        return " ".join(vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(n))

    rows = [(k, text(rng.choice([1, 5, 40, 400]))) for k in range(400)]
    rows += [(k, rows[7][1]) for k in range(900, 860, -1)]
    items = [(k, text(rng.choice([1, 6, 25]))) for k in range(40)]
    check(spark, rows, items, top=rng.choice([1, 3, 10]))


def test_buckets_lose_no_document_and_pass_over_most():
    """Single-task search with buckets of a few rows: equal to scoring all; far bounds are not scored."""
    rng = np.random.default_rng(4)
    width, rows = 60, 900
    dense = rng.integers(1, 900_000, (rows, width)) * (rng.random((rows, width)) < 0.2)
    dense = dense[np.argsort(-np.sqrt((dense.astype(float) ** 2).sum(1)), kind="stable")]
    dense = dense[dense.sum(1) > 0]
    weight = rng.integers(0, 9000, width)
    own = [np.sort(rng.choice(width, rng.integers(1, 9), replace=False)) for _ in range(30)]
    items = lexical.Items(np.arange(30), pa.array([b""] * width), np.concatenate(own), np.concatenate([[0], np.cumsum([len(o) for o in own])]))
    search = lexical.Search.of(items, weight, 5)
    best = lexical.Best(search)
    for k in range(0, len(dense), 16):
        part = dense[k : k + 16]
        row, code = np.nonzero(part)
        offsets = np.searchsorted(row, np.arange(len(part) + 1))
        norm = np.sqrt((part.astype(float) ** 2).sum(1))
        lexical.search_bucket(search, best, norm, code, part[row, code], offsets, np.arange(k, k + len(part)), np.zeros(len(part), bool))
    for q, codes in enumerate(own):
        score = dense[:, codes] @ weight[codes]
        order = np.lexsort((np.arange(len(dense)), -score))[:5]
        order = order[score[order] > 0]
        assert best.rows[q][0].tolist() == score[order].tolist() and best.rows[q][1].tolist() == order.tolist()


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
    rows = [(k, f"a{k % 3} b{k % 5} c{k}") for k in range(40)]
    items = [(1, "a0 b1"), (2, "a1 b2 c3 c4"), (3, "c5"), (4, "b0")]
    check(spark, rows, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs(spark, ODD), none).collect() == []
    assert lexical.search(empty(spark), one).collect() == []
