"""Near duplicates by b-bit MinHash: bands of minima propose, packed low bits estimate, full sets decide.

Documents with the same shingle set are one node (its id is a 128-bit digest of the set), so copies cost one row.  Each
node has 128 minima; 32 bands of four propose candidates, of which a pair at the threshold misses all with
probability 5e-6.  The low four bits of the minima are packed in eight longs; equal fields, corrected for chance hits,
estimate the similarity, and pairs far below the threshold (six standard deviations) go no further.  The others are
decided on the full sets.

In a bucket nobody is paired with everybody.  First every member is paired with the bucket's smallest node.  Nodes that
share buckets, directly or by a chain, are a cluster; after the components of the first links are known, a cluster is done if
it lies in one component.  In the others the members outside the largest component are compared with all members of other
components: both are dealt by hash to tiles of bounded size, and each pair of tiles is one group, in which the
packed signatures are compared by bit counts and likely pairs decided on the full sets.  A group returns what is
connected, as many rows as it has members at most, and no pairs.  Pairs inside one component can't change it.  So no link that
matters for the components is lost, whatever the size of a bucket.

Defined results: a null text counts as empty; a text without words has an empty set and is linked with nothing, and its
component is its own doc_id; fewer words than a shingle are one shingle; equal sets are always linked; repeated
rows get a row each; null doc_ids never become a component unless all of a group are null; an empty table gives no rows; extra
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from featherloom.llm.components import components, merge
from featherloom.llm.words import docs_and_texts, free_name, schema_with, small, text_of
from featherloom.session import release, seal

LONGS = T.ArrayType(T.LongType(), False)
SKETCH = schema_with(
    ("doc_id", T.LongType()),
    ("text_hash", T.LongType()),
    ("n_shingles", T.LongType()),
    ("node", T.BinaryType()),
    ("bands", LONGS),
    ("packed", LONGS),
)

#: Words a task keeps the hashes of.
TABLE_WORDS = 300_000


@dataclass(frozen=True)
class NearSettings:
    """words: of a shingle; percent: similarity that links; bands, rows: of the minima; bits: kept of each minimum.

    least_percent: estimates below it are not looked at any further; tile: nodes of a tile on average.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 4
    least_percent: int = 50
    tile: int = 512
    seed: int = 11

    @property
    def minima(self) -> int:
        return self.bands * self.rows


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in small parts; a worker that is used again afterwards keeps no hashes of this task's words."""
    yield from small(batches)
    _HASHES.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted 64-bit hashes, and their sketches."""

    def __init__(self, settings: NearSettings):
        self.settings = settings
        draw = np.random.default_rng(settings.seed)
        odd = lambda n, kind, top: draw.integers(0, top, n, dtype=kind, endpoint=True) | kind(1)
        self.powers = odd(settings.words, np.uint64, 2**64 - 1)
        self.factors = odd(settings.minima, np.uint32, 2**32 - 1)[:, None]
        self.shifts = draw.integers(0, 2**32 - 1, settings.minima, dtype=np.uint32, endpoint=True)[:, None]
        self.band_powers = odd(settings.rows, np.uint64, 2**64 - 1)
        self.band_salts = draw.integers(0, 2**63 - 1, settings.bands, dtype=np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct shingles of a text; A-Z count as a-z."""
        if len(_HASHES) > TABLE_WORDS:
            _HASHES.clear()
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        word = np.array([_HASHES[w] for w in words], np.uint64)
        k = min(self.settings.words, len(words))
        n = len(words) - k + 1
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total += word[j : j + n] * self.powers[j]
        return np.unique(_mixed(total))

    @staticmethod
    def node(shingles: np.ndarray) -> bytes | None:
        import xxhash

        return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.settings.minima, 2**32 - 1, np.uint32)
        for begin in range(0, len(low), 1024):
            hashed = low[None, begin : begin + 1024] * self.factors
            hashed += self.shifts
            np.minimum(best, hashed.min(axis=1), out=best)
        return best

    def bands(self, minima: np.ndarray) -> np.ndarray:
        s = self.settings
        keys = (minima.reshape(s.bands, s.rows).astype(np.uint64) * self.band_powers).sum(axis=1, dtype=np.uint64)
        return _mixed(_mixed(keys) + self.band_salts).view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the minima, 64 / bits of them in a long."""
        per = 64 // self.settings.bits
        low = (minima & np.uint32(2**self.settings.bits - 1)).astype(np.uint64).reshape(-1, per)
        return (low << (np.arange(per, dtype=np.uint64) * np.uint64(self.settings.bits))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands, packed) of each document; no node without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for batch in parts(batches):
            n, node, bands, packed = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingler.shingles(text)
                n.append(len(found))
                node.append(shingler.node(found))
                minima = shingler.minima(found) if len(found) else None
                bands.append(shingler.bands(minima) if len(found) else [])
                packed.append(shingler.packed(minima) if len(found) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.binary()),
                    pa.array(bands, longs),
                    pa.array(packed, longs),
                ],
                names=SKETCH.names,
            )

    rows = docs_and_texts(docs).select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text")
    return rows.mapInArrow(sketch, SKETCH)


def estimate(a: Column, b: Column, settings: NearSettings = NearSettings()) -> Column:
    """Similarity (0 to 1, or a little below 0) from two packed signatures, corrected for chance hits."""
    bits, minima = settings.bits, settings.minima
    lowest = sum(1 << k for k in range(0, 64, bits))
    lowest -= 2**64 if lowest >= 2**63 else 0

    def differing(x: Column) -> Column:
        """Fields of a XOR that are not zero."""
        step = 1
        while step < bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(lowest)))

    longs = minima * bits // 64
    total = sum((differing(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(1, longs)),
                differing(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
    chance = 2.0**-bits
    return ((F.lit(float(minima)) - total) / minima - chance) / (1 - chance)


def _likely(a: Column, b: Column, settings: NearSettings) -> Column:
    return estimate(a, b, settings) * 100 >= settings.least_percent


def confirmed(pairs: DataFrame, texts: DataFrame, settings: NearSettings) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough; ``texts`` is (node, text)."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in parts(batches):
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(batch.num_rows):
                if last[0] != a[i]:
                    last = a[i], shingler.shingles(left[i].encode())
                other = shingler.shingles(right[i].encode())
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= settings.percent * (len(last[1]) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", "left", "right").mapInArrow(decide, "a binary, b binary")


#: Columns of a block of the incidence product, and rows of a block of signatures compared at once.
COLUMNS, ROWS = 4096, 64


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every one on the right: an incidence product."""
    total = np.zeros((len(left), len(right)), np.float32)
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    border = sum(map(len, left))
    sides = []
    for sets, own in ((left, column[:border]), (right, column[border:])):
        sides.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets]), own))
    both = (np.bincount(sides[0][1], minlength=len(values)) > 0) & (np.bincount(sides[1][1], minlength=len(values)) > 0)
    place = np.cumsum(both) - 1
    packed = []
    for row, own in sides:
        row, own = row[both[own]], place[own[both[own]]]
        order = np.argsort(own, kind="stable")
        packed.append((row[order], own[order]))
    for begin in range(0, int(both.sum()), COLUMNS):
        blocks = []
        for n, (row, own) in zip((len(left), len(right)), packed):
            a, b = np.searchsorted(own, [begin, begin + COLUMNS])
            block = np.zeros((n, COLUMNS), np.float32)
            block[row[a:b], own[a:b] - begin] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total


def likely_pairs(left: np.ndarray, right: np.ndarray, settings: NearSettings) -> np.ndarray:
    """Whether the estimate of two packed signatures is high enough, for all rows of two tiles."""
    out = np.zeros((len(left), len(right)), bool)
    lowest = np.uint64(sum(1 << k for k in range(0, 64, settings.bits)))
    chance = 2.0**-settings.bits
    most = settings.minima * (1 - (settings.least_percent / 100 * (1 - chance) + chance))
    for begin in range(0, len(left), ROWS):
        x = left[begin : begin + ROWS, None, :] ^ right[None, :, :]
        step = 1
        while step < settings.bits:
            x |= x >> np.uint64(step)
            step *= 2
        out[begin : begin + ROWS] = np.bitwise_count(x & lowest).sum(axis=2, dtype=np.int64) <= most
    return out


def across(members: DataFrame, groups: DataFrame, known: DataFrame, settings: NearSettings) -> DataFrame:
    """(a, b): connections between nodes of different components that share buckets by a chain.

    members: (key, node, head); groups: (node, component); known: (node, packed, text).
    """
    stars = members.where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    clusters = components(stars).withColumnRenamed("component", "cluster")
    tagged = clusters.join(groups, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("own"))
    sizes = tagged.groupBy("cluster", "own").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("cluster").agg(F.max(F.struct("n", "own")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    tiles = lambda n: F.ceil(n / settings.tile).cast("int")
    plan = mixed.where("parts > 1").select(
        "cluster", F.col("main.own").alias("main"), tiles(F.col("n")).alias("all"), tiles(F.col("n") - F.col("main.n")).alias("out")
    )
    rows = seal(tagged.join(plan, "cluster").join(known, "node"), "mixed")
    drawn = F.xxhash64("node")
    outside = rows.where(F.col("own") != F.col("main")).withColumn("i", F.pmod(drawn, F.col("out")).cast("int"))
    outside = outside.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).withColumn("side", F.lit(0))
    every = rows.withColumn("j", F.pmod(drawn, F.col("all")).cast("int"))
    every = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("out") - 1))).withColumn("side", F.lit(1))
    kept = ["cluster", "i", "j", "side", "node", "own", "packed", "text"]

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        node, own = group.column("node").to_pylist(), group.column("own").to_pylist()
        number = {x: k for k, x in enumerate(dict.fromkeys(own))}
        part = np.array([number[x] for x in own], np.int64)
        packed = np.array(group.column("packed").to_pylist(), np.int64).view(np.uint64)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        likely = likely_pairs(packed[a], packed[b], settings) & (part[a][:, None] != part[b][None, :])
        a, b, likely = a[likely.any(axis=1)], b[likely.any(axis=0)], likely[likely.any(axis=1)][:, likely.any(axis=0)]
        head = np.arange(len(node))
        if len(a):
            shingler = Shingler(settings)
            text = group.column("text")
            sets = {k: shingler.shingles(text[k].as_py().encode()) for k in (*a.tolist(), *b.tolist())}
            left, right = [sets[k] for k in a.tolist()], [sets[k] for k in b.tolist()]
            shared = shared_sizes(left, right)
            whole = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - shared
            x, y = np.nonzero(likely & (100 * shared >= settings.percent * whole))
            if len(x):
                head = merge(head, a[x], b[y])
        _HASHES.clear()
        led = np.flatnonzero(head != np.arange(len(head)))
        ends = [[node[k] for k in led.tolist()], [node[k] for k in head[led].tolist()]]
        return pa.table({"a": pa.array(ends[0], pa.binary()), "b": pa.array(ends[1], pa.binary())})

    both = outside.select(*kept).unionByName(every.select(*kept))
    return both.groupBy("cluster", "i", "j").applyInArrow(compare, "a binary, b binary")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, settings: NearSettings) -> DataFrame:
    """(node, text) of the wanted nodes, from the document that stands for each."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            own = [shingler.node(shingler.shingles(t.encode())) for t in texts]
            keep = [x == y for x, y in zip(own, batch.column(0).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    named_docs = nodes.join(wanted, "node", "left_semi").select("node", F.col("standing").alias("doc_id"))
    texts = docs_and_texts(docs).select(F.col("doc_id").cast("bigint").alias("id"), "text")
    found = texts.join(named_docs, texts["id"].eqNullSafe(named_docs["doc_id"])).select("node", "text")
    # A doc_id may stand on several rows; the digest tells which text is the node's.
    return found.mapInArrow(named, "node binary, text string").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, component_id, kept) of each document."""
    found = seal(sketches(docs, settings), "sketches")
    nodes = seal(
        found.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("standing"), F.first("bands").alias("bands"), F.first("packed").alias("packed")),
        "nodes",
    )
    keys = nodes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = seal(keys.join(heads, "key"), "buckets")
    packed = nodes.select("node", "packed")

    stars = members.where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    signed = stars.join(packed.toDF("a", "pa"), "a").join(packed.toDF("b", "pb"), "b")
    first = seal(signed.where(_likely(F.col("pa"), F.col("pb"), settings)).select("a", "b"), "pairs")
    # Whoever shares a bucket may be compared; a node whose only bucket mates were unlikely is still a member.
    wanted = members.select("node").distinct()
    texts = seal(_texts(docs, nodes, wanted, settings), "texts")
    links = seal(confirmed(first, texts, settings), "near-links")
    groups = seal(components(links), "groups")

    late = seal(across(members, groups, nodes.select("node", "packed").join(texts, "node"), settings), "near-links")
    if not late.isEmpty():
        groups = seal(components(links.unionByName(late)), "groups")

    standing = nodes.select("node", "standing").join(groups, "node", "left").withColumn("own", F.coalesce("component", "node"))
    smallest = standing.groupBy("own").agg(F.min("standing").alias("component_id"))
    named = standing.select("node", "own").join(smallest, "own").select("node", "component_id")
    out = seal(
        found.select("doc_id", "text_hash", "n_shingles", "node")
        .join(named, "node", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            "node",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))),
        "near-duplicates",
    )
    for done in (found, nodes, members, first, texts, links, late):
        release(done)
    return out


def keep_one(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """One document of each group, with the columns it came with; texts without words all stay.

    Of repeated rows one stays: the rows of a kept text are numbered after the join that finds them, in its partitions.
    """
    hashed, number = free_name(docs, "hash_of_text"), free_name(docs, "row_of_text")
    told = near_duplicates(docs, settings).where("kept")
    kept = told.select(
        F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash"), F.col("node").isNotNull().alias("_near_words")
    ).distinct()
    marked = docs.withColumn(hashed, F.xxhash64(text_of("text")))
    found = marked.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_near_id")) & (F.col(hashed) == F.col("_near_hash")))
    same = Window.partitionBy("_near_id", "_near_hash").orderBy("_near_hash")
    rows = found.withColumn(number, F.when(F.col("_near_words"), F.row_number().over(same)).otherwise(1))
    return rows.where(F.col(number) == 1).select(*(marked[c] for c in docs.columns))
