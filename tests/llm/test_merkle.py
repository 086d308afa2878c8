"""Merkle logs and proofs against a plain tree over all rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from featherloom.llm import merkle

from .rows import DOCS, ODD, docs, empty


def digest(s):
    return sha256(s.encode()).hexdigest()


def leaf_of(doc, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def climb(leaves):
    """Levels from the leaves to the only node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append((level[first:i], level[i + 1 : first + 8]))
        i //= 8
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for doc, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc, source, lang, n_chars, text)
        hit = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit else text
        claim = leaf_of(doc, source, lang, n_chars, low)
        trees.setdefault("0" if lang is None else "1" + lang, []).append((doc is not None, doc or 0, leaf, claim, doc))
    names = sorted(trees, key=str.encode)
    climbed = {}
    for name in names:
        trees[name].sort(key=lambda r: r[:3])
        climbed[name] = climb([r[2] for r in trees[name]])
    top = climb([climbed[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, leaf, claim, doc) in enumerate(trees[name]):
            way = siblings(climbed[name], i) + siblings(top, k)
            folded = claim
            for before, after in way:
                folded = digest("".join([*before, folded, *after]))
            proof = digest("".join("".join(b + a) for b, a in way))
            out.append((doc, leaf, climbed[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, *(["x"] * 9)) for i, t, g, s, n in rows], DOCS)


def check(spark, rows, levels=merkle.LEVELS):
    manifest = merkle.build(frame(spark, rows), merkle.tampered(), levels)
    got = merkle.proofs(manifest)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == brute(rows)
    manifest.release()
    return found


@pytest.mark.parametrize("n", [*range(1, 20), 63, 64, 65, 511, 512, 513, 4095, 4096])
def test_logs_are_postorder_and_addresses_hit_their_nodes(n):
    leaves = [sha256(str(k).encode()).digest() for k in range(n)]
    levels = climb([h.hex() for h in leaves])
    log = merkle.append_log(leaves, merkle.height_of(n))
    assert len(log) == sum(map(len, levels)) and log[-1].hex() == levels[-1][0]
    for level, nodes in enumerate(levels):
        for k, node in enumerate(nodes):
            assert log[merkle.position(level, k, n)].hex() == node


def test_odd_documents(spark):
    rows = [(i, t, "en", "src1", None if t is None else len(t)) for i, t in ODD]
    rows += [(20, "Of No Language", None, None, None), (21, "ÉA B", "", "s", 4), (22, "lone", "zz", "s", 4), (3, "Three", "de", "s", 5)]
    found = check(spark, rows)
    assert any(r[6] for r in found) and not all(r[6] for r in found)


@pytest.mark.parametrize("levels,n", [(1, 75), (1, 600), (2, 400)])
def test_several_rounds(spark, levels, n):
    """Small blocks: trees of several rounds beside trees of one, and a last tree of several rounds."""
    rows = [(k * 7 % n, f"Text {k}", "en" if k % 3 else f"l{k % 90}", "s", k) for k in range(n)]
    check(spark, rows, levels)


def test_one_row_and_equal_rows(spark):
    check(spark, [(1, "Only One", "en", "s", 8)])
    check(spark, [(1, "Same", "en", "s", 4)] * 30)


def test_empty_table(spark):
    assert merkle.proofs(merkle.build(empty(spark))).collect() == []


def test_own_leaves_always_verify(spark):
    got = merkle.proofs(merkle.build(docs(spark, ODD)))
    assert got.where(~F.col("verified")).count() == 0
