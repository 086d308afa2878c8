"""Language-model scores: a log-bilinear network over token types, trained by noise-contrastive estimation.

Tokens are words with A-Z in lower case, and one end for each text.  The network's types are the most frequent words, classes of
the other words by their last two characters, and the end.  It predicts a type from the two before it:

    score(w | c1, c2) = bias[w] + (in[c1] M1 + in[c2] M2) . out[w]

A word of a class has its class's probability times its smoothed share of the class, so the probabilities of all
words, seen or not, add up to one.  Since the contexts are pairs of types, the normaliser of every context comes out of a few
batched matrix products, once; scoring a token is then three look-ups.

Everything counted covers all training documents.  Word counts are combined in tasks before the shuffle.  The types, classes and a
bounded dictionary of frequent words go to the tasks; counts of all other words are joined by key.  Training runs
replicas over all training tokens at once (each task descends on its share, then parameters are averaged by weight in a
grouped sum), so more data is more replicas and not a longer list.

Defined results: a null text counts as empty; an empty text is one end token; documents with a null id are held out;
repeated rows are scored each; without training documents every token is unseen and the network is uniform; an empty
table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.llm.words import schema_with, small, text_of
from featherloom.session import release, seal

REST = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
ENCODED = schema_with(
    ("row", T.LongType()),
    ("doc_id", T.LongType()),
    ("held_out", T.BooleanType()),
    ("n_tokens", T.LongType()),
    ("n_known", T.LongType()),
    ("counted", T.DoubleType()),
    ("in_class", T.DoubleType()),
    ("types", T.BinaryType()),
    ("rest", REST),
)


@dataclass(frozen=True)
class LmSettings:
    """words, classes: types of the network; dictionary: frequent words whose counts tasks hold (the others are joined).

    width: of the vectors; noise: noise words per token; rounds: passes over all training tokens, with an average of
    the replicas after each; replicas: at most so many at once; batch: tokens of a step at most.
    """

    words: int = 400
    classes: int = 110
    dictionary: int = 100_000
    width: int = 24
    noise: int = 5
    rounds: int = 2
    replicas: int = 64
    batch: int = 32_768
    rate: float = 0.1
    seed: int = 3


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over (text); combined in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: Counter) -> pa.RecordBatch:
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in small(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(tokens_of(text))
                if len(found) > 300_000:
                    yield told(found)
                    found = Counter()
        if found:
            yield told(found)

    return docs.select(text_of("text").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of the words.  ``numbers``: word to its place in ``types`` and ``counts``."""

    numbers: dict[bytes, int]
    types: np.ndarray
    counts: np.ndarray
    suffixes: dict[str, int]
    class_log: np.ndarray
    mass: np.ndarray
    n: int
    distinct: int
    ends: int
    #: Types below this are words.
    short: int = 0

    @property
    def size(self) -> int:
        """Number of types; the begin of a text is the context ``size``."""
        return len(self.mass)

    @property
    def end(self) -> int:
        return self.size - 1

    @property
    def log_all(self) -> float:
        """log10 of the base model's denominator."""
        return float(np.log10(self.n + 0.5 * (self.distinct + 1)))

    def class_of(self, word: str) -> int:
        return self.suffixes.get(word[-2:], self.size - 2)


def vocabulary(counts: DataFrame, ends: int, settings: LmSettings) -> Vocabulary:
    """Types and dictionary from the word counts (a written table) and the number of training documents."""
    order = [F.desc("c"), "word"]
    # Words above a quantile first: a bare limit would send that many words from every task to the driver.
    total = counts.count()
    frequent = counts
    if total > settings.dictionary:
        least = counts.agg(F.percentile_approx("c", 1 - settings.dictionary / total, 10_000)).first()[0]
        frequent = counts.where(F.col("c") > least)
    top = frequent.orderBy(*order).limit(settings.dictionary).collect()
    if len(top) < settings.words:
        top = counts.orderBy(*order).limit(settings.words).collect()
    short = top[: settings.words]
    # Words not among the types; at most ``words`` rows are broadcast.
    listed = counts.sparkSession.createDataFrame([(r["word"],) for r in short], "word string")
    others = counts.join(F.broadcast(listed), "word", "left_anti").select(F.right("word", F.lit(2)).alias("suffix"), "c")
    by_suffix = seal(others.groupBy("suffix").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")), "suffixes")
    named = by_suffix.orderBy(F.desc("n"), "suffix").limit(settings.classes).collect()
    all_n, all_v = by_suffix.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    release(by_suffix)
    n_class = [r["n"] for r in named] + [all_n - sum(r["n"] for r in named)]
    v_class = [r["v"] for r in named] + [all_v - sum(r["v"] for r in named)]
    suffixes = {r["suffix"]: len(short) + k for k, r in enumerate(named)}
    mass = np.array([*(r["c"] for r in short), *n_class, ends], np.float64)
    class_log = np.zeros(len(mass))
    class_log[len(short) : -1] = np.log10(np.array(n_class) + 0.5 * (np.array(v_class) + 1.0))
    out = Vocabulary({}, np.zeros(0, np.int16), np.zeros(0), suffixes, class_log, mass, 0, 0, ends, len(short))
    types = [k if k < len(short) else out.class_of(r["word"]) for k, r in enumerate(top)]
    out.numbers = {r["word"].encode(): k for k, r in enumerate(top)}
    out.types, out.counts = np.array(types, np.int16), np.array([r["c"] for r in top], np.int64)
    out.n = int(sum(r["c"] for r in short)) + int(all_n) + ends
    out.distinct = len(short) + int(all_v) + (ends > 0)
    return out


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Texts as type numbers, what the dictionary knows of them, and the words it doesn't know with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        find = v.numbers.get
        logs = np.log10(v.counts + 0.5)
        short = v.short
        log_end = float(np.log10(v.ends + 0.5))
        for batch in small(batches):
            n, known, counted, in_class, types, rest = [], [], [], [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                tokens = tokens_of(text)
                code = np.array([find(w, -1) for w in tokens], np.int64)
                there = code >= 0
                own = np.empty(len(tokens) + 1, np.int16)
                own[-1] = v.end
                own[:-1][there] = v.types[code[there]]
                unknown: Counter = Counter()
                for k in np.flatnonzero(~there).tolist():
                    word = tokens[k].decode()
                    own[k] = v.class_of(word)
                    unknown[word] += 1
                log = logs[code[there]]
                inside = own[:-1][there] >= short
                n.append(len(own))
                known.append(int(there.sum()) + (v.ends > 0))
                counted.append(float(log.sum()) + log_end)
                in_class.append(float(log[inside].sum()) - float(v.class_log[own].sum()))
                types.append(own.tobytes())
                rest.append([{"word": w, "n": c} for w, c in unknown.items()])
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(counted, pa.float64()),
                    pa.array(in_class, pa.float64()),
                    pa.array(types, pa.binary()),
                    pa.array(rest, kind),
                ],
                names=ENCODED.names,
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "held_out", text_of("text").alias("text")
    )
    return rows.mapInArrow(run, ENCODED)


class LogBilinear:
    """Parameters of the network over ``size`` types."""

    def __init__(self, mass: np.ndarray, width: int, seed: int = 0):
        self.mass = mass
        size = len(mass)
        draw = np.random.default_rng(seed)
        small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        self.noise = ((mass + 0.5) / (mass + 0.5).sum()).astype(np.float64)
        self.w = {
            "bias": np.log(self.noise).astype(np.float32)[None, :],
            "in": small(size + 1, width),
            "out": small(size, width),
            "m1": np.eye(width, dtype=np.float32),
            "m2": np.eye(width, dtype=np.float32) * np.float32(0.5),
        }

    @property
    def size(self) -> int:
        return len(self.mass)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every type after every type one and two places back (without the bias)."""
        w = self.w
        return w["in"] @ w["m1"] @ w["out"].T, w["in"] @ w["m2"] @ w["out"].T

    def normalisers(self) -> np.ndarray:
        """log of the sum of exp(score) for every context (c1, c2), a block of contexts at a time."""
        one, two = self.tables()
        # exp(a + b + c) = exp(a + c) exp(b): the sum over types is a matrix product.
        one = one + self.w["bias"]
        top_one, top_two = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        product = np.exp((one - top_one).astype(np.float64)) @ np.exp((two - top_two).astype(np.float64)).T
        return (np.log(product) + top_one + top_two.T).astype(np.float32)

    def fit(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, settings: LmSettings, seed: int) -> None:
        """One pass of noise-contrastive estimation over the tokens, in batches, with AdaGrad."""
        size, k = self.size, settings.noise
        draw = np.random.default_rng(seed)
        pool = draw.choice(size, 1 << 18, p=self.noise)
        shift = np.log(k * self.noise).astype(np.float32)
        past = {name: np.full_like(v, 1e-8) for name, v in self.w.items()}
        batch = int(np.clip(len(w) // 100, 512, settings.batch))
        for begin in range(0, len(w), batch):
            a, b, word = c1[begin : begin + batch], c2[begin : begin + batch], w[begin : begin + batch]
            one, two = self.tables()
            other = pool[draw.integers(0, len(pool), (k, len(word)))]
            every = np.concatenate([word[None], other])
            at_one, at_two = a[None] * size + every, b[None] * size + every
            score = one.ravel()[at_one] + two.ravel()[at_two] + self.w["bias"][0][every] - shift[every]
            error = -1.0 / (1.0 + np.exp(-score))
            error[0] += 1.0
            error = error.ravel() / np.float32(len(word))
            shape = (size + 1, size)
            g1 = np.bincount(at_one.ravel(), error, size * (size + 1)).reshape(shape).astype(np.float32)
            g2 = np.bincount(at_two.ravel(), error, size * (size + 1)).reshape(shape).astype(np.float32)
            h1, h2 = self.w["in"] @ self.w["m1"], self.w["in"] @ self.w["m2"]
            d1, d2 = g1 @ self.w["out"], g2 @ self.w["out"]
            slope = {
                "bias": g1.sum(axis=0, keepdims=True),
                "out": g1.T @ h1 + g2.T @ h2,
                "in": d1 @ self.w["m1"].T + d2 @ self.w["m2"].T,
                "m1": self.w["in"].T @ d1,
                "m2": self.w["in"].T @ d2,
            }
            for name, g in slope.items():
                past[name] += g * g
                self.w[name] += np.float32(settings.rate) * g / np.sqrt(past[name])


def contexts(types: np.ndarray, lengths: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Type one and two places back of every token of texts laid end to end; ``begin`` before a text."""
    c1 = np.concatenate([[begin], types[:-1]])[: len(types)].astype(np.int64)
    c2 = np.concatenate([[begin, begin], types[:-2]])[: len(types)].astype(np.int64)
    first = np.cumsum(lengths)[:-1] if len(lengths) else np.zeros(0, np.int64)
    first = np.concatenate([[0], first]).astype(np.int64)[: len(lengths)]
    c1[first] = begin
    c2[first] = begin
    second = (first + 1)[lengths > 1]
    c2[second] = begin
    return c1, c2


def _joined(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), np.int16).astype(np.int64), np.array([len(r) // 2 for r in raw], np.int64)


def train(encoded: DataFrame, words: Vocabulary, settings: LmSettings) -> LogBilinear:
    """Network over the types of the rows that are not held out; ``encoded`` is a written table."""
    spark = encoded.sparkSession
    network = LogBilinear(words.mass, settings.width, settings.seed)
    rows = encoded.where(~F.col("held_out")).select("types").coalesce(settings.replicas)
    for turn in range(settings.rounds):
        shared = spark.sparkContext.broadcast(network)

        def descend(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            import copy

            from pyspark import TaskContext

            own = copy.deepcopy(shared.value)
            seen = 0
            seed = settings.seed + 1000 * turn + 7 * TaskContext.get().partitionId()
            held: list[pa.RecordBatch] = []

            def learn() -> None:
                nonlocal seen, held
                if held:
                    types, lengths = (np.concatenate(x) for x in zip(*(_joined(b, "types") for b in held)))
                    c1, c2 = contexts(types, lengths, own.size)
                    own.fit(c1, c2, types, settings, seed + seen)
                    seen += len(types)
                    held = []

            # About four million tokens (8 MB) at a time.
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    held.append(batch.slice(k, 1000))
                    if sum(b.nbytes for b in held) > 8_000_000:
                        learn()
            learn()
            if seen:
                for name, value in own.w.items():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(value), pa.string()),
                            pa.array(np.arange(len(value)), pa.int32()),
                            pa.array([float(seen)] * len(value), pa.float64()),
                            pa.array(list(value.astype(np.float64)), pa.list_(pa.float64())),
                        ],
                        names=["name", "line", "seen", "value"],
                    )

        replicas = rows.mapInArrow(descend, "name string, line int, seen double, value array<double>")
        cells = replicas.select("name", "line", "seen", F.posexplode("value").alias("place", "x"))
        mean = cells.groupBy("name", "line", "place").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x"))
        lines = mean.groupBy("name", "line").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("cells"))
        # As many numbers as the network has parameters.
        for r in lines.select("name", "line", "cells.x").collect():
            network.w[r["name"]][r["line"]] = r["x"]
    return network


def neural(encoded: DataFrame, network: LogBilinear) -> DataFrame:
    """(row, neural): log10 probability of each text's types."""
    one, two = network.tables()
    shared = encoded.sparkSession.sparkContext.broadcast(
        ((one + network.w["bias"]).astype(np.float32), two.astype(np.float32), network.normalisers())
    )
    size = network.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, norm = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                types, lengths = _joined(batch, "types")
                c1, c2 = contexts(types, lengths, size)
                log = one[c1, types].astype(np.float64) + two[c2, types] - norm[c1, c2]
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                total = np.add.reduceat(log, first) / np.log(10.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64())], names=["row", "neural"])

    return encoded.select("row", "types").mapInArrow(run, "row long, neural double")


def score_documents(docs: DataFrame, held_out, settings: LmSettings = LmSettings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held_out`` is a column of ``docs``."""
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = rows.where(~F.col("held_out"))
    counts = seal(count_words(training), "word-counts")
    words = vocabulary(counts, training.count(), settings)
    encoded = seal(encode(rows, words), "encoded")
    network = train(encoded, words, settings)

    used = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    found = used.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = found.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rest_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known")
    )
    whole = encoded.drop("types", "rest").join(neural(encoded, network), "row").join(rest, "row", "left")
    more = F.coalesce("rest_log", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(words.n).cast("bigint").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * F.lit(words.log_all)).alias("base_score"),
        (F.col("neural") + F.col("in_class") + more).alias("score"),
    )
