"""Token ids of whole texts, word by word: the same ids as the tokenizer gives for the whole text.

The tokenizer's own pre-splitting never joins characters across white space, and its normaliser works on single
characters and marks, so the ids of a text are the ids of its words one after another.  Words repeat; each task keeps
the ids of the words it has met in a table of bounded size.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a task keeps before it drops those met once: about 200 bytes each.
TABLE_WORDS = 1_200_000

#: Bytes of text encoded in one go; a longer text is a go of its own.
SLICE_BYTES = 2_000_000

#: Id put after each document.
END_ID = 1

#: Letters whose words are one piece of the tokenizer: ASCII and Latin-1, already in lower case and composed.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_TAIL = b".,!?;:*%&$|"


def _byte_letters() -> dict[str, str]:
    """Letters to the characters that stand for their UTF-8 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in shown}
    sign |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in sign)}
    letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
    return {x: "".join(sign[b] for b in x.encode()) for x in letters}


class WordEncoder(dict):
    """Word (bytes) to its number; the ids of word k are ``flat[starts[k] : starts[k + 1]]``."""

    def __init__(self, path: str, table_words: int | None = None):
        super().__init__()
        self.limit = table_words or TABLE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(_byte_letters())
        self.flat, self.starts = array("I"), array("q", [0])
        self.met = np.zeros(0, np.int64)

    def count(self, code: np.ndarray) -> None:
        """Note how often words were met."""
        met = np.bincount(code, minlength=len(self.starts) - 1)
        met[: len(self.met)] += self.met
        self.met = met

    def forget(self) -> None:
        """Drop the words met once; of the others at most the more frequent half of the table stays."""
        least = 2
        if np.count_nonzero(self.met >= 2) > self.limit // 2:
            least = int(np.partition(self.met, -self.limit // 2)[-self.limit // 2]) + 1
        old, flat, starts, met = dict(self), self.flat, self.starts, self.met
        self.clear()
        self.flat, self.starts = array("I"), array("q", [0])
        kept = []
        for word, k in old.items():
            if k < len(met) and met[k] >= least:
                self[word] = len(kept)
                kept.append(k)
                self.flat.extend(flat[starts[k] : starts[k + 1]])
                self.starts.append(len(self.flat))
        # Halved, so that words that have gone out of use leave in time.
        self.met = met[kept] // 2 if kept else np.zeros(0, np.int64)

    def ids_of(self, word: bytes) -> Iterable[int]:
        # A special token's string may stand inside a word, and is looked for before lower-casing.
        if b"<|" in word or b"'" in word:
            return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        stem = word.rstrip(_TAIL)
        if stem and len(stem) < len(word):
            if stem[-1:].isalpha() or stem[-1] >= 128:
                text = stem.decode().lower()
                if _PLAIN.fullmatch(text):
                    return [*self.own(text.encode()), *self.own(word[len(stem) :])]
        elif stem:
            text = word.decode().lower()
            if _PLAIN.fullmatch(text):
                return [t.id for t in self.model.tokenize(text.translate(self.letters))]
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def own(self, word: bytes) -> array:
        k = self[word]
        return self.flat[self.starts[k] : self.starts[k + 1]]

    def __missing__(self, word: bytes) -> int:
        ids = self.ids_of(word)  # may add other words first
        number = len(self.starts) - 1
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self[word] = number
        return number

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each begins (one more than texts)."""
        if len(self) > self.limit:
            self.forget()
        numbers: list[int] = []
        ends = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            numbers.extend([self[w] for w in text.split()])
            ends[i] = len(numbers)
        code = np.array(numbers, np.int64)
        self.count(code)
        starts = np.frombuffer(self.starts, np.int64)
        first, lengths = starts[code], starts[code + 1] - starts[code]
        before = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        plain = flat[np.repeat(first - before[:-1], lengths) + np.arange(before[-1])]
        offsets = np.concatenate([[0], before[ends]]) + np.arange(len(texts) + 1)
        out = np.full(offsets[-1], END_ID, np.uint32)
        keep = np.ones(offsets[-1], bool)
        keep[offsets[1:] - 1] = False
        out[keep] = plain
        return out, offsets


_ENCODERS: dict[tuple[str, int | None], WordEncoder] = {}


def encoder(path: str, table_words: int | None = None) -> WordEncoder:
    """This process's encoder for a vocabulary file; ``table_words`` bounds its table."""
    if (path, table_words) not in _ENCODERS:
        _ENCODERS[path, table_words] = WordEncoder(path, table_words)
    return _ENCODERS[path, table_words]


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a text column of about ``SLICE_BYTES``: place of the first, and the texts."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= SLICE_BYTES or i + 1 == len(sizes):
            yield begin, column.slice(begin, i + 1 - begin).cast(pa.binary()).to_pylist()
            begin, size = i + 1, 0


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)
