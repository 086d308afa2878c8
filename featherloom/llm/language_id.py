"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads runs of letters and their combining marks, byte by byte in both directions, and gives every position a
distribution over the languages; a document's probabilities are the mean over its positions.  Runs are read on their own
(the state starts anew at each) and whole, however long, so the positions of a word are the same wherever it stands, and a
task computes each word it meets once and keeps the sums in a table of bounded size.  All positions of all runs count.

It is trained in numpy by backpropagation through time on the letter runs of a bounded sample of labelled documents,
chosen by hash and equally from every language; a run that several languages use gets their shares as its target.  Every
language of a labelled document with a letter has runs in the sample; only here long runs are cut, between characters.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled row everything is
``und``; ties go to the first language in sorted order; repeated rows get a row each; an empty table gives no
rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.words import share_of_long, text_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageSettings:
    """Bounds of the sample and sizes of the network.

    documents: labelled documents per language, on average; runs: letter runs learned from, over all languages;
    rare: runs of a language that is in none of those; piece: bytes learned from at once, longer runs in such pieces.
    """

    documents: int = 500
    runs: int = 40_000
    rare: int = 64
    piece: int = 24
    embedding: int = 12
    hidden: int = 16
    epochs: int = 8
    batch: int = 512
    rate: float = 0.01
    seed: int = 5


def letter_runs(text: str, piece: int | None = None) -> list[bytes]:
    """Runs of letters and their marks in lower case as UTF-8; with ``piece``, long ones cut at or just before so many bytes."""
    import regex

    out = []
    for run in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
        raw, begin = run.encode(), 0
        while piece and len(raw) - begin > piece:
            end = begin + piece
            # Bytes 10xxxxxx continue a character.
            while end > begin and raw[end] & 0xC0 == 0x80:
                end -= 1
            end = end if end > begin else begin + piece
            out.append(raw[begin:end])
            begin = end
        out.append(raw[begin:])
    return out


#: Steps of long runs held at once, and numbers of an array (steps, rows, languages).
STEPS, NUMBERS = 1024, 16_000_000


def rows_at_once(steps: int, width: int) -> int:
    return max(1, NUMBERS // (steps * width))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class ByteNetwork:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax at every position."""

    def __init__(self, languages: list[str], settings: LanguageSettings, seed: int | None = None):
        self.languages, self.settings = languages, settings
        draw = np.random.default_rng(settings.seed if seed is None else seed)
        e, h, n = settings.embedding, settings.hidden, len(languages)
        flat = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"embed": flat(256, e) * np.float32(np.sqrt(256)), "out": flat(2 * h, n), "out_bias": np.zeros(n, np.float32)}
        for side in ("f", "b"):
            self.w |= {f"{side}_in": flat(e, 3 * h), f"{side}_state": flat(h, 3 * h), f"{side}_bias": np.zeros(3 * h, np.float32)}

    def _run(self, side: str, data: np.ndarray, keep: bool, start: np.ndarray | None = None):
        """States (steps, rows, hidden) of one direction over bytes (rows, steps); what backward needs if ``keep``."""
        h = self.settings.hidden
        table = self.w["embed"] @ self.w[f"{side}_in"] + self.w[f"{side}_bias"]
        state_w = self.w[f"{side}_state"]
        steps = range(data.shape[1]) if side == "f" else range(data.shape[1] - 1, -1, -1)
        state = np.zeros((len(data), h), np.float32) if start is None else start
        out = np.empty((data.shape[1], len(data), h), np.float32)
        kept = []
        for t in steps:
            x, s = table[data[:, t]], state @ state_w
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            if keep:
                kept.append((t, state, z, r, new, s[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out, kept

    def probabilities(self, data: np.ndarray, keep: bool = False):
        """(steps, rows, languages) for bytes (rows, steps) of equal length."""
        forward, kept_f = self._run("f", data, keep)
        backward, kept_b = self._run("b", data, keep)
        both = np.concatenate([forward, backward], axis=2)
        p = self._labels(both)
        return (p, both, kept_f, kept_b) if keep else p

    def _labels(self, both: np.ndarray) -> np.ndarray:
        """Distributions (steps, rows, languages) of the states of both directions."""
        score = both @ self.w["out"] + self.w["out_bias"]
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def _summed(self, data: np.ndarray) -> np.ndarray:
        """(rows, languages): probabilities summed over the steps, of which at most STEPS are held at once.

        A first pass from the end leaves the backward states at the borders of the parts, so nothing is cut.
        """
        begins = range(0, data.shape[1], STEPS)
        after = {begins[-1]: None}
        for begin in reversed(begins[1:]):
            after[begin - STEPS] = self._run("b", data[:, begin : begin + STEPS], False, after[begin])[0][0]
        total, before = np.zeros((len(data), len(self.languages)), np.float64), None
        for begin in begins:
            part = data[:, begin : begin + STEPS]
            forward = self._run("f", part, False, before)[0]
            before = forward[-1]
            backward = self._run("b", part, False, after[begin])[0]
            total += self._labels(np.concatenate([forward, backward], axis=2)).sum(axis=0)
        return total

    def _back(self, side: str, data: np.ndarray, kept: list, d_out: np.ndarray, grad: dict) -> None:
        """Backpropagation through time of one direction; ``d_out`` is the slope at each state."""
        h = self.settings.hidden
        state_w = self.w[f"{side}_state"]
        d_table = np.zeros((256, 3 * h), np.float32)
        d_state_w = np.zeros_like(state_w)
        d_next = np.zeros((len(data), h), np.float32)
        for t, before, z, r, new, s_new in reversed(kept):
            d = d_out[t] + d_next
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * s_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_s = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_table, data[:, t], d_x)
            d_state_w += before.T @ d_s
            d_next = d * z + d_s @ state_w.T
        grad[f"{side}_state"] = d_state_w
        grad[f"{side}_bias"] = d_table.sum(axis=0)
        grad[f"{side}_in"] = self.w["embed"].T @ d_table
        grad["embed"] = grad.get("embed", 0) + d_table @ self.w[f"{side}_in"].T

    def gradient(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean weighted cross entropy over positions, and its slopes; target (rows, languages), weight (rows,)."""
        h = self.settings.hidden
        p, both, kept_f, kept_b = self.probabilities(data, keep=True)
        share = (weight / (weight.sum() * data.shape[1]))[None, :, None]
        loss = float(-(share * target[None] * np.log(np.maximum(p, 1e-12))).sum())
        d = (p - target[None]) * share
        grad = {"out": np.einsum("tbi,tbj->ij", both, d), "out_bias": d.sum(axis=(0, 1))}
        d_both = d @ self.w["out"].T
        self._back("f", data, kept_f, d_both[:, :, :h], grad)
        self._back("b", data, kept_b, d_both[:, :, h:], grad)
        return loss, grad

    def fit(self, runs: list[bytes], shares: list[dict[int, float]], weight: np.ndarray) -> list[float]:
        """Adam over batches of runs of one length; ``shares``: of the languages of each run. Mean loss of each epoch."""
        s = self.settings
        draw = np.random.default_rng(s.seed + 1)
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, run in enumerate(runs):
            by_length[len(run)].append(k)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, told = 0, []
        for epoch in range(s.epochs):
            batches = []
            for length, rows in by_length.items():
                rows = draw.permutation(rows)
                most = min(s.batch, rows_at_once(length, len(self.languages)))
                batches += [rows[k : k + most] for k in range(0, len(rows), most)]
            total = 0.0
            rate = s.rate * (1 - epoch / s.epochs)
            for k in draw.permutation(len(batches)):
                rows = batches[k]
                data = np.frombuffer(b"".join(runs[i] for i in rows), np.uint8).reshape(len(rows), -1)
                target = np.zeros((len(rows), len(self.languages)), np.float32)
                for n, i in enumerate(rows):
                    target[n, list(shares[i])] = list(shares[i].values())
                loss, grad = self.gradient(data, target, weight[rows])
                total += loss
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for name, g in grad.items():
                    g = g * min(1.0, 1.0 / (size + 1e-12))
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.w[name] -= (rate * move).astype(np.float32)
            told.append(total / max(1, len(batches)))
        return told

    def sums(self, runs: list[bytes]) -> np.ndarray:
        """(runs, languages + 1): sum of the probabilities of all positions, and their number."""
        out = np.zeros((len(runs), len(self.languages) + 1), np.float32)
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, run in enumerate(runs):
            by_length[len(run)].append(k)
        for length, rows in by_length.items():
            most = min(2048, rows_at_once(min(length, STEPS), len(self.languages) + 2 * self.settings.hidden))
            for k in range(0, len(rows), most):
                part = rows[k : k + most]
                data = np.frombuffer(b"".join(runs[i] for i in part), np.uint8).reshape(len(part), length)
                out[part, :-1] = self._summed(data)
                out[part, -1] = length
        return out


#: Bytes of the table of word sums a task keeps, and words at most.
TABLE_BYTES, TABLE_WORDS = 64_000_000, 500_000


class WordSums(dict):
    """White-space word (bytes) to its row in a table of position sums."""

    def __init__(self, network: ByteNetwork):
        super().__init__()
        self.network = network
        width = len(network.languages) + 1
        self.most = max(1000, min(TABLE_WORDS, TABLE_BYTES // (4 * width)))
        self.table = np.zeros((0, width), np.float32)
        self.met = np.zeros(0, np.int64)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def forget(self) -> None:
        """Keep the words met again, at most the more frequent half of the table."""
        least = 2
        if np.count_nonzero(self.met >= 2) > self.most // 2:
            least = int(np.partition(self.met, -self.most // 2)[-self.most // 2]) + 1
        old, table, met = list(self.items()), self.table, self.met
        self.clear()
        kept = [(w, k) for w, k in old if met[k] >= least]
        self.update((w, n) for n, (w, _) in enumerate(kept))
        rows = [k for _, k in kept]
        self.table, self.met = table[rows], met[rows] // 2

    def _learn(self) -> None:
        """Rows of the words met for the first time."""
        words, self.fresh = self.fresh, []
        number: dict[bytes, int] = {}
        runs = [[number.setdefault(r, len(number)) for r in letter_runs(w.decode())] for w in words]
        sums = self.network.sums(list(number))
        owner = np.repeat(np.arange(len(words)), [len(r) for r in runs])
        rows = np.zeros((len(words), sums.shape[1]), np.float32)
        np.add.at(rows, owner, sums[[k for r in runs for k in r]] if number else np.zeros((0, sums.shape[1]), np.float32))
        self.table = np.concatenate([self.table, rows])

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages + 1): position sums of whole texts."""
        if len(self) > self.most:
            self.forget()
        codes = [np.array([self[w] for w in text.split()], np.int64) for text in texts]
        if self.fresh:
            self._learn()
        flat = np.concatenate([*codes, np.zeros(0, np.int64)])
        met = np.bincount(flat, minlength=len(self.table))
        met[: len(self.met)] += self.met
        self.met = met
        return np.array([self.table[c].sum(axis=0, dtype=np.float64) for c in codes]).reshape(len(texts), -1)


def held_out(key: str = "doc_id", remainder: int = 0) -> Column:
    """True for documents whose crc32 of the id as text leaves ``remainder`` by 5; null ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == remainder, F.lit(True))


def train(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> ByteNetwork:
    """Network learned from the text and lang of documents that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return ByteNetwork([], settings)
    spark = docs.sparkSession
    share = spark.createDataFrame([(r["lang"], min(1.0, settings.documents / r["n"])) for r in counts], "lang string, share double")
    chosen = known.join(F.broadcast(share), "lang").where(share_of_long(F.xxhash64(F.lit(settings.seed), F.col("doc_id"))) < F.col("share"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, bytes], int] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(letter_runs(text, settings.piece)).items():
                    found[lang, run] += n
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in found], pa.string()),
                    "run": pa.array([k[1] for k in found], pa.binary()),
                    "n": pa.array(list(found.values()), pa.int64()),
                }
            )

    runs = chosen.select("lang", "text").mapInArrow(spell, "lang string, run binary, n long")
    by_run = runs.groupBy("run", "lang").agg(F.sum("n").alias("n"))
    # At most ``runs`` rows, all languages of a run together since the order is by the run's hash.
    rows = by_run.orderBy(F.xxhash64(F.lit(settings.seed), "run"), "run", "lang").limit(settings.runs).collect()
    missed = sorted(set(languages) - {r["lang"] for r in rows})
    if missed:
        # Languages with so few runs that none was drawn: their first runs, again with all languages of each.
        drawn = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(settings.seed), "run"), "run")
        few = by_run.join(F.broadcast(spark.createDataFrame([(x,) for x in missed], "lang string")), "lang")
        few = few.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= settings.rare).select("run").distinct()
        rows = sorted({*rows, *by_run.join(few, "run", "left_semi").collect()}, key=lambda r: (bytes(r["run"]), r["lang"]))
    place = {x: k for k, x in enumerate(languages)}
    uses: dict[bytes, dict[int, int]] = defaultdict(dict)
    for r in rows:
        uses[bytes(r["run"])][place[r["lang"]]] = r["n"]
    network = ByteNetwork(languages, settings)
    total = np.array([sum(u.values()) for u in uses.values()], np.float32)
    if uses:
        network.fit(list(uses), [{k: n / t for k, n in u.items()} for u, t in zip(uses.values(), total)], np.sqrt(total))
    return network


_TABLES: dict[bytes, WordSums] = {}


def predict(docs: DataFrame, network: ByteNetwork, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    stamp = b"".join(v.tobytes() for v in network.w.values())[:4096]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _TABLES:
            _TABLES.clear()
            _TABLES[stamp] = WordSums(network)
        table = _TABLES[stamp]
        most = max(1, min(500, 128_000 // (len(network.languages) + 1)))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), most):
                part = texts[a : a + most]
                sums = table.pooled(part) if network.languages else np.zeros((len(part), 1))
                mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
                some = sums[:, -1] > 0
                best = mean.argmax(axis=1) if network.languages else np.zeros(len(part), int)
                names = [network.languages[k] if ok else UNDETERMINED for k, ok in zip(best, some)]
                score = np.where(some, mean.max(axis=1, initial=0.0), 0.0).clip(0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(part)), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(label, "doc_id long, lang_pred string, score double")
