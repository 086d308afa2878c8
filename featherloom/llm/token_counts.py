"""Token counts of whole texts for a byte-pair vocabulary, by rank-synchronous merging (see ``ragged_bpe``).

A task takes its texts in slices, finds the distinct words of a slice, merges their pre-tokens together and adds up the
counts per text.  Nothing is kept from slice to slice, so memory is bounded by a slice (or the longest single text).

Defined results: a null text counts as empty, with no bytes and no tokens; every row is counted, repeated ones and ones
with a null doc_id too; an empty table gives an empty result; extra columns are not looked at.  Strings of the
vocabulary's added tokens inside a text are those tokens, as the tokenizers library has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.ragged_bpe import RaggedBpe, ragged_bpe
from featherloom.llm.words import docs_and_texts

#: Bytes of text whose distinct words are merged together.
SLICE_BYTES = 8_000_000

COUNTED = "doc_id long, n_bytes long, n_tokens long"


def counts_of(bpe: RaggedBpe, texts: pa.Array) -> np.ndarray:
    """Number of tokens of each text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    per_word = bpe.counts(coded.dictionary.to_pylist())
    total = np.concatenate([[0], np.cumsum(per_word[coded.indices.to_numpy(zero_copy_only=False)])])
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    return np.diff(total[bounds])


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``SLICE_BYTES``; a longer text is a run of its own or ends one."""
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= SLICE_BYTES or k + 1 == len(sizes):
            yield begin, k + 1
            begin, held = k + 1, 0


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``over_limit`` where there are more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ragged_bpe(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(sizes):
                n = counts_of(bpe, batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    rows = docs_and_texts(docs, key, text).select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, COUNTED).withColumn("over_limit", F.col("n_tokens") > limit)
