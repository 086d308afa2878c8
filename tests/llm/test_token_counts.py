"""Rank-synchronous merging against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featherloom.llm import ragged_bpe, token_counts, tokens, word_table

from .rows import ODD, docs, empty

PATH = tokens.vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)
BPE = ragged_bpe.ragged_bpe(PATH)
HARD = [
    "it's DON'T we'll !'s 'S x's",
    "x<|endoftext|>y<|startoftext|><|ENDOFTEXT|> <|endoftext|><|endoftext|>",
    "ÉCOLE café. café ẞA ß! ΑΣ İx",
    "a\x85b \xa0c\x1cd 12a3 你好。x",
    "हिन्दी भाषा" * 100,
    "...,!? a*** b,, ́ ‍",
    "aaaaaaa aaaa aa",
    "",
    " \n\t\x0b",
]


def library(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def counts(texts):
    return token_counts.counts_of(BPE, pa.array(texts, pa.string())).tolist()


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert counts([text]) == [library(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_texts(texts):
    assert counts(texts) == [library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x17F), max_size=20), max_size=6))
def test_latin_texts(texts):
    assert counts(texts) == [library(t) for t in texts]


@pytest.mark.parametrize("bound", [1, 8, 256])
def test_linked_and_ragged_sequences_agree_with_the_library(monkeypatch, bound):
    monkeypatch.setattr(ragged_bpe, "LONG_SYMBOLS", bound)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabcdeé") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += ["a" * 777, "ab" * 300, "你好世界" * 80, *HARD]
    assert counts(texts) == [library(t) for t in texts]


def test_merged_ids_are_the_librarys():
    words = ["straße", "unbelievable", "don't", "x" * 300, "12ab"]
    for w in words:
        data, sizes, _ = BPE.pieces([w])
        ids, n, code = BPE.piece_ids(data, sizes)
        starts = np.cumsum(n) - n
        got = [i for c in code for i in ids[starts[c] : starts[c] + n[c]].tolist()]
        assert got == TOKENIZER.encode(w, add_special_tokens=False).ids


def own_ids(table, text):
    return table.encode(pa.array([text]))[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_ids_from_a_word_table(texts):
    got, offsets = word_table.word_table(PATH).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert got[offsets[k] : offsets[k + 1]].tolist() == [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1]


def test_hard_ids_and_a_table_that_is_always_full():
    table = word_table.WordTable(PATH, table_bytes=2000)
    texts = [*HARD, *[f"the same words and new{chr(97 + k)} ones{chr(97 + k)} here" for k in range(26)], "ab" * 4000, *HARD]
    for t in texts:
        assert own_ids(table, t) == [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1]
        assert len(table.young) < 60 and all(len(w) <= word_table.LONG_BYTES for w in table.young)


def test_texts_without_spaces_stay_out_of_the_table():
    table = word_table.WordTable(PATH)
    own_ids(table, " ".join("你好世界" * 200 + chr(0x4E00 + k) for k in range(50)))
    assert len(table.young) == 0


def test_a_vocabulary_with_white_space_in_its_pieces_is_refused():
    with pytest.raises(ValueError):
        ragged_bpe.RaggedBpe(tokens.vocabulary("byte_bpe_50k.json"))


def test_odd_documents(spark):
    got = token_counts.count_tokens(docs(spark, ODD), PATH, limit=150)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), library(t), library(t) > 150) for i, t in ODD]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[3] for r in want) and not all(r[3] for r in want)


def test_slices_cover_every_text(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 50)
    sizes = np.array([0, 10, 60, 0, 49, 1, 1, 0])
    runs = list(token_counts.slices(sizes))
    assert [k for a, b in runs for k in range(a, b)] == list(range(len(sizes)))
    assert list(token_counts.slices(np.zeros(0, np.int64))) == []


def test_empty_table(spark):
    assert token_counts.count_tokens(empty(spark), PATH).collect() == []
