"""Byte-pair merging of many pre-tokens at once, in ragged NumPy arrays.

Pre-tokens lie one after another in a flat array of symbols.  Each round takes every sequence's lowest-rank pair and
merges all its places at once; finished sequences leave the array, so a round costs what is still open.  A long sequence
would need a round over all its symbols for each rank in it; those are linked instead, and a round touches only the
places of its rank.

That one round may merge all places of a pair is checked when a vocabulary is read: each token has one merge that makes
it, and every merge that uses it has a higher rank, so merging never opens a lower rank than the one at hand.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rank of a pair that has no merge.
NONE = np.int32(2**31 - 1)

#: Sequences with more symbols than this are linked.
LONG_SYMBOLS = 256

#: The pattern of the word vocabulary, and what it comes to on the UTF-8 bytes of lower-cased words in Latin letters:
#: ASCII and the letters of Latin-1, none of which the normaliser joins to another.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile(r"[\x00-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
LATIN_PIECES = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]|\xc2[\xaa\xb5\xba])+|[0-9]|[^\x09-\x0D\x20a-z0-9\x80-\xff]+|\x20"
)


def byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where it is shown, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


def every_other(places: np.ndarray, touching: np.ndarray) -> np.ndarray:
    """Of ascending places, in each run of overlapping ones the first, third, ...; ``touching[k]``: k overlaps k - 1."""
    begins = np.flatnonzero(~touching)
    inside = np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))
    return places[inside % 2 == 0]


class RaggedBpe:
    """Merges of one vocabulary file with byte-level pieces that drop white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair vocabularies are read")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must match as they are written")
        self.library = Tokenizer.from_file(path)
        characters = byte_characters()
        normal, cut = self.library.normalizer, self.library.pre_tokenizer
        told = [p for p, _ in cut.pre_tokenize_str(normal.normalize_str("aB \t é"))] if normal and cut else []
        if told != ["ab", "".join(characters[b] for b in "é".encode())]:
            raise ValueError("only byte-level vocabularies that lower-case and drop white space are read")
        self.fast_latin = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern") == {"Regex": WORD_PATTERN}
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, self.special_ids)) + ")") if added else None

        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        self.first = np.array([[vocab[c] for c in characters], [vocab[c + end] for c in characters]], np.int32)
        self.byte_of = np.zeros(max(map(ord, characters)) + 1, np.uint8)
        self.byte_of[[ord(c) for c in characters]] = np.arange(256)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(key).astype(np.int32)
        self.keys = key[self.order]
        born = np.full(self.size, -1, np.int64)
        born[self.made] = np.arange(len(merges))
        rank = np.arange(len(merges))
        once = len(np.unique(self.made)) == len(merges)
        if not once or (born[self.left] >= rank).any() or (born[self.right] >= rank).any():
            raise ValueError("a token is made twice or used before it is made: ranks can't be merged at once")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where there is no merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive, sequence after sequence, and how many each has; no sequence is empty."""
        out = np.empty(len(lengths), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        long = lengths > LONG_SYMBOLS
        for chosen, run in ((~long, self._rounds), (long, self._linked)):
            numbers = np.flatnonzero(chosen)
            if len(numbers):
                inside = symbols if len(numbers) == len(lengths) else symbols[np.repeat(chosen, lengths)]
                parts += run(inside, lengths[numbers], numbers, out)
        if not parts:
            return symbols[:0], out
        flat, owner = np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts])
        return flat[np.argsort(owner, kind="stable")], out

    def _rounds(self, symbols, lengths, numbers, out):
        """Rounds over all open sequences; yields finished symbols with their sequence's number."""
        rank = np.full(len(symbols), NONE, np.int32)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        ends = np.cumsum(lengths)
        rank[ends - 1] = NONE
        while len(lengths):
            best = np.minimum.reduceat(rank, ends - lengths)
            open_ = best < NONE
            if not open_.all():
                keep = np.repeat(open_, lengths)
                done = ~open_
                out[numbers[done]] = lengths[done]
                yield symbols[~keep], np.repeat(numbers[done], lengths[done])
                symbols, rank = symbols[keep], rank[keep]
                lengths, numbers, best = lengths[open_], numbers[open_], best[open_]
                if not len(lengths):
                    return
            places = np.flatnonzero(rank == np.repeat(best, lengths))
            touching = np.concatenate([[False], np.diff(places) == 1])
            if touching.any():
                places = every_other(places, touching)
            symbols[places] = self.made[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            owner = np.searchsorted(np.cumsum(lengths), places, side="right")
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            symbols, rank = symbols[keep], rank[keep]
            ends = np.cumsum(lengths)
            places = places - np.arange(len(places))
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            rank[places] = NONE
            inner = places[~last[places]]
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            before = places[places > 0] - 1
            before = before[~last[before]]
            rank[before] = self.ranks(symbols[before], symbols[before + 1])

    def _linked(self, symbols, lengths, numbers, out):
        """Ranks in ascending order over linked sequences; a round touches the places of its rank alone."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def await_(places: np.ndarray) -> None:
            rank = self.ranks(symbols[places], symbols[after[places]])
            places, rank = places[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(places, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        await_(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            a, b = self.left[r], self.right[r]
            places = places[(symbols[places] == a) & (after[places] >= 0)]
            places = places[symbols[after[places]] == b]
            if a == b and len(places) > 1:
                places = every_other(places, np.concatenate([[False], after[places[:-1]] == places[1:]]))
            gone = after[places]
            symbols[places], symbols[gone] = self.made[r], -1
            beyond = after[gone]
            after[places] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = places[linked]
            front = before[places]
            await_(np.unique(np.concatenate([places[linked], front[front >= 0]])))
        alive = symbols >= 0
        left = np.add.reduceat(alive.astype(np.int64), ends - lengths)
        out[numbers] = left
        yield symbols[alive], np.repeat(numbers, left)

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pre-tokens, their lengths and the word each belongs to, for words without added tokens."""
        plain = [k for k, w in enumerate(words) if w.isascii() or LATIN.fullmatch(w)] if self.fast_latin else []
        found = []
        if plain:
            joined = " ".join([words[k] for k in plain]).lower().encode()
            data = np.frombuffer(joined, np.uint8)
            # Pieces and spaces tile the text, since white space is what words are split at.
            sizes = np.fromiter(map(len, LATIN_PIECES.findall(joined)), np.int64)
            space = data[np.cumsum(sizes) - sizes] == 32
            owner = np.array(plain)[np.cumsum(space)]
            found.append((data[np.repeat(~space, sizes)], sizes[~space], owner[~space]))
        if len(plain) < len(words):
            rest = np.setdiff1d(np.arange(len(words)), plain)
            normal = [self.library.normalizer.normalize_str(words[k]) for k in rest.tolist()]
            begin = np.cumsum([0, *[len(w) + 1 for w in normal]])
            cut = self.library.pre_tokenizer.pre_tokenize_str(" ".join(normal))
            if cut:
                sizes = np.fromiter((len(p) for p, _ in cut), np.int64)
                at = np.fromiter((a for _, (a, _) in cut), np.int64)
                codes = np.frombuffer("".join(p for p, _ in cut).encode("utf-32-le"), np.uint32)
                found.append((self.byte_of[codes], sizes, rest[np.searchsorted(begin, at, side="right") - 1]))
        if not found:
            return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, sizes, owner = (np.concatenate(x) for x in zip(*found))
        return data, sizes, owner

    def piece_ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens merged: flat ids, how many each has, and the number of each given pre-token's own."""
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, bounds.buffers()[1], pa.py_buffer(data)])
        coded = told.dictionary_encode()
        own = coded.dictionary
        lengths = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(own.buffers()[2], np.uint8)[: lengths.sum()]
        symbols = self.first[0][flat]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.first[1][flat[last]]
        ids, n = self.merge(symbols, lengths)
        return ids, n, coded.indices.to_numpy(zero_copy_only=False)

    def segments(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words cut at added tokens: the parts between them, the word of each part, and added tokens in each word."""
        added = np.zeros(len(words), np.int64)
        special = [k for k, w in enumerate(words) if "<" in w and self.special.search(w)] if self.special else []
        if not special:
            return words, np.arange(len(words)), added
        parts, owner = list(words), list(range(len(words)))
        for k in special:
            cut = self.special.split(words[k])
            added[k] = len(cut) // 2
            parts[k] = cut[0]
            parts += cut[2::2]
            owner += [k] * (len(cut) // 2)
        return parts, np.array(owner), added

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each word (a text without white space)."""
        parts, word, total = self.segments(words)
        data, sizes, owner = self.pieces(parts)
        if len(sizes):
            _, n, code = self.piece_ids(data, sizes)
            total += np.bincount(word[owner], n[code], minlength=len(words)).astype(np.int64)
        return total


_READ: dict[str, RaggedBpe] = {}


def ragged_bpe(path: str) -> RaggedBpe:
    """This process's merges for a vocabulary file."""
    if path not in _READ:
        _READ[path] = RaggedBpe(path)
    return _READ[path]
