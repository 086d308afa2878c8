"""Token ids of whole texts from their distinct words, with a table of bounded bytes.

The vocabulary never joins characters across white space, so the ids of a text are those of its words one after another.
The distinct words of a slice are looked up together and the ones not known are merged together (see ``ragged_bpe``).
What is known lies in two generations: words in use move to the younger, and when that is full the older goes.  Words of
more than ``LONG_BYTES`` (texts without spaces, encoded data) are never kept, so the table is bounded whatever the texts.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from featherloom.llm.ragged_bpe import RaggedBpe, ragged_bpe
from featherloom.llm.tokens import END_ID

#: Bytes of a generation: a word is counted as its length, four bytes an id, and what Python needs for an entry.
TABLE_BYTES = 64_000_000
ENTRY_BYTES = 180
LONG_BYTES = 64


def word_ids(bpe: RaggedBpe, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one after another, and how many each has."""
    parts, word, added = bpe.segments(words)
    special = set(np.flatnonzero(added).tolist())
    if special:
        # Strings of added tokens inside words are rare: the library puts ids and parts in order.
        parts = ["" if k in special else w for k, w in enumerate(words)]
    data, sizes, owner = bpe.pieces(parts)
    ids, n, code = bpe.piece_ids(data, sizes) if len(sizes) else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(owner, kind="stable")
    code, owner = code[order], owner[order]
    counts = np.bincount(owner, n[code], minlength=len(words)).astype(np.int64)
    flat = gathered(ids, np.cumsum(n) - n, n, code)
    if special:
        runs = np.split(flat, np.cumsum(counts)[:-1])
        for k in special:
            runs[k] = np.array(bpe.library.encode(words[k], add_special_tokens=False).ids, np.int32)
            counts[k] = len(runs[k])
        flat = np.concatenate(runs)
    return flat, counts


def gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that ``chosen`` names, one after another."""
    lengths = sizes[chosen]
    total = int(lengths.sum())
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    place = np.repeat((first[chosen] - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    place += np.arange(total, dtype=kind)
    return flat[place]


class Generation(dict):
    """Words (and their numbers) with their ids."""

    def __init__(self):
        super().__init__()
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.n = 0
        self.bytes = 0

    def add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new words."""
        numbers = np.arange(self.n, self.n + len(words))
        self.flat.append(flat)
        self.sizes.append(sizes)
        self.n += len(words)
        self.bytes += 4 * len(flat) + 8 * len(words)
        for word, number in zip(words, numbers.tolist()):
            if len(word) <= LONG_BYTES:
                self[word] = number
                self.bytes += len(word) + ENTRY_BYTES
        return numbers

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each word's begin, and how many it has."""
        if len(self.flat) > 1:
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        if not self.flat:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = self.sizes[0]
        return self.flat[0], np.cumsum(sizes) - sizes, sizes


class WordTable:
    """A task's table for one vocabulary file."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        self.bpe = ragged_bpe(path)
        self.limit = table_bytes
        self.young, self.old = Generation(), Generation()

    def numbers(self, words: list[str]) -> np.ndarray:
        """Place of each distinct word in the younger generation, where all of them are afterwards."""
        if self.young.bytes > self.limit:
            self.young, self.old = Generation(), self.young
        found = np.fromiter(map(self.young.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0)
        if not len(unknown):
            return found
        asked = [words[k] for k in unknown.tolist()]
        before = np.fromiter(map(self.old.get, asked, repeat(-1)), np.int64, len(asked))
        known = before >= 0
        if known.any():
            flat, first, sizes = self.old.arrays()
            moved = before[known]
            again = [w for w, k in zip(asked, known.tolist()) if k]
            found[unknown[known]] = self.young.add(again, gathered(flat, first, sizes, moved), sizes[moved])
        if not known.all():
            new = [w for w, k in zip(asked, known.tolist()) if not k]
            found[unknown[~known]] = self.young.add(new, *word_ids(self.bpe, new))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each begins (one more than texts)."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        known = self.numbers(coded.dictionary.to_pylist())
        flat, first, sizes = self.young.arrays()
        # The end is one more word, put after the words of each text.
        flat, first, sizes = np.append(flat, np.int32(END_ID)), np.append(first, len(flat)), np.append(sizes, 1)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)) + np.arange(len(texts))
        number = np.full(len(coded) + len(texts), len(sizes) - 1, np.int64)
        inside = np.ones(len(number), bool)
        inside[ends] = False
        number[inside] = known[coded.indices.to_numpy(zero_copy_only=False)]
        before = np.concatenate([[0], np.cumsum(sizes[number])])
        return gathered(flat, first, sizes, number).view(np.uint32), before[np.concatenate([[0], ends + 1])]


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """This process's table for a vocabulary file."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
