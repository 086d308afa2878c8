"""Token ids, packing and the token store against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featherloom.llm import packing, token_store, tokens
from featherloom.session import scratch_path, seal

from .rows import ODD, docs, empty

PATH = tokens.vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_words_one_by_one_give_the_ids_of_the_text(texts):
    got, offsets = tokens.encoder(PATH).encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert got[offsets[k] : offsets[k + 1]].tolist() == ids(t).tolist()


@pytest.mark.parametrize(
    "text",
    ["it's DON'T we'll !'s", "<|endoftext|>x <|ENDOFTEXT|>", "ÉCOLE café. café ẞA ß! ΑΣ İx", "a\x85b \xa0c\x1cd 12a3 你好。x", "...,!? a*** b,,", ""],
)
def test_hard_texts(text):
    got, _ = tokens.encoder(PATH).encode([text.encode()])
    assert got.tolist() == ids(text).tolist()


def test_a_full_table_keeps_repeated_words_and_the_ids(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 10)
    own = tokens.WordEncoder(PATH)
    texts = [f"the same words and new{chr(97 + k)} ones{chr(97 + k)} here" for k in range(20)]
    for t in texts:
        got, _ = own.encode([t.encode()])
        assert got.tolist() == ids(t).tolist()
    assert b"same" in own and len(own) < 40


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=30))
def test_plan_places_every_length_once_without_gaps(counts):
    plan = packing.Plan(counts, 64)
    ranks = defaultdict(list)
    fill = defaultdict(list)
    for length, a, b, first, times, offset in plan.rows:
        assert b - a == times
        ranks[length] += range(a, b)
        for k in range(times):
            fill[first + k].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in fill.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 64


def test_two_replace_the_smallest_when_they_fit_better():
    # Greedy takes 6, then 3 (gap 1); 2 and 2 fill the expanded gap of 4.
    plan = packing.Plan({6: 1, 3: 1, 2: 2}, 10)
    first = sorted(length for length, _, _, s, _, _ in plan.rows if s == 0)
    assert first == [2, 2, 6]


def check_packed(rows, expected, size):
    by_sequence = defaultdict(list)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= size
    want = defaultdict(list)
    for doc, text in expected:
        own = ids(text)
        want[doc] += [(k, b, len(own[b : b + size]), zlib.crc32(own[b : b + size].tobytes())) for k, b in enumerate(range(0, len(own), size))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_sequence)


@pytest.mark.parametrize("size,bucket_rows", [(4096, 2_000_000), (50, 3)])
def test_packing_odd_documents(spark, size, bucket_rows):
    cut = seal(packing.pieces(docs(spark, ODD), PATH, size))
    check_packed(packing.pack(cut, size, bucket_rows).collect(), ODD, size)


def test_packing_is_near_the_bound(spark):
    rows = [(k, "word " * (k % 37 + 1)) for k in range(500)]
    cut = seal(packing.pieces(docs(spark, rows), PATH, 50))
    n = check_packed(packing.pack(cut, 50, 100).collect(), rows, 50)
    assert n <= -(-sum(len(ids(t)) for _, t in rows) // 50) + 2


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store_round_trip(spark, encoding):
    path = scratch_path(spark, "store")
    token_store.write(docs(spark, ODD), path, PATH, token_store.StoreSettings(encoding=encoding), shards=3)
    stored = sorted(((r["doc_id"], r["ids"]) for r in token_store.read(spark, path).collect()), key=str)
    assert stored == sorted(((i, ids(t).tolist()) for i, t in ODD), key=str)
    rows = sorted(token_store.checked(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in rows[:2]] == [None, None]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(ids(t).tobytes()) for _, t in ODD)


def test_store_layout_and_selective_reads(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "store")
    token_store.write(docs(spark, [(k, f"text number {k} " * 20) for k in range(300)]), path, PATH, shards=3)
    encodings = set()
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_column_index and column.has_offset_index
                encodings |= {(column.path_in_schema, e) for e in column.encodings}
    assert ("doc_id", "DELTA_BINARY_PACKED") in encodings
    assert any(p.startswith("ids") and "DICTIONARY" in e for p, e in encodings)
    some = token_store.read_documents(spark, path, 100, 120)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,120)]" in some._jdf.queryExecution().toString()
    assert some.count() == 21
    assert "ids" not in token_store.read(spark, path, ["doc_id", "n_tokens"])._jdf.queryExecution().executedPlan().toString()


def test_empty_store(spark):
    path = scratch_path(spark, "store")
    token_store.write(empty(spark), path, PATH)
    assert token_store.checked(spark, path).count() == 0
