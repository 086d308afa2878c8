"""Exact ranked search for a set of items over all documents, with vectors in buckets by length.

A document is a vector of impacts over the items' terms, an item a vector of term weights, a score their inner product.
Vectors are range-partitioned and sorted by length, longest first, so a block of consecutive rows is a bucket of nearly
equal lengths.  An item passes over a bucket that cannot reach its threshold (the score of its tenth document so far) by
the Cauchy-Schwarz inequality, or by the largest impact of each of its terms in the bucket.  Inside a bucket the few
heaviest coordinates are added exactly and the rest is bounded in the same two ways; what survives is scored in integers.
Bounds are compared with the threshold itself, so documents of equal score are never passed over.

Thresholds come from the bucket of the longest vectors, searched first, and rise inside every task.  A task keeps ten rows
an item, whatever the number of documents that tie.

Items are worked off in blocks of a bounded number of terms, each over all documents; what a block broadcasts (its terms,
weights and thresholds) is bounded by that.

Defined results: null texts and texts without a term are not ranked and count nowhere; every document row is ranked by
itself, repeated ones too, and every item row is answered by itself; of equal scores the smaller doc_id goes first, null
doc_ids last; items without a term have no rows; an empty table on either side gives no rows; extra columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.token_counts import slices
from featherloom.llm.words import docs_and_texts
from featherloom.session import release, seal

#: Terms of the items searched for together (a longer item is a block of its own).
BLOCK_TERMS = 500_000

#: Rows of a bucket.
BUCKET_ROWS = 2048

#: Share of an item's squared length that its exactly added coordinates make up.
FOCUS = 0.75

#: Share of the vectors, the longest ones, that give the first thresholds.
FIRST_SHARE = 1 / 16

#: Groups in which the tasks' rows are thinned out before those of an item meet.
GROUPS = 64

#: Relative room for rounding in bounds: they are double sums of a few thousand terms.
ROOM = 1e-9


def _letters() -> np.ndarray:
    """Byte to byte: ASCII letters lower-cased, digits and bytes beyond ASCII as they are, 0 for all others."""
    kept = np.zeros(256, np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        kept[a:b] = np.arange(a, b)
    kept[65:91] = np.arange(97, 123)
    return kept


LETTERS = _letters()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of texts (UTF-8), in order: the text of each, and the terms."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = LETTERS[data]
    inside = low != 0
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = np.diff(offsets) > 0
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(offsets, begin, side="right") - 1
    bounds = pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64))
    return owner, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, bounds.buffers()[1], pa.py_buffer(low[inside])])


@dataclass
class Items:
    """A block of items: their distinct terms as one vocabulary, and each item's codes one after another."""

    numbers: np.ndarray
    vocabulary: pa.Array
    codes: np.ndarray
    starts: np.ndarray


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, item_id, terms): distinct terms of every item that has one; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, terms = terms_of(batch.column(1))
            told = terms.to_pylist()
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            own = [sorted(set(told[a:b])) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema[key].dataType.simpleString()
    named = items.select(F.col(key).alias("item_id"), F.coalesce(text, F.lit("")).alias("text"))
    found = named.mapInArrow(run, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    return seal(found.withColumn("item", F.monotonically_increasing_id()), "search-items")


def item_blocks(told: DataFrame) -> Iterator[Items]:
    """Items in blocks of at most ``BLOCK_TERMS`` terms."""

    def packed(rows: list) -> Items:
        flat = pa.array([bytes(t) for r in rows for t in r["terms"]], pa.large_binary()).dictionary_encode()
        starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])])
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return Items(np.array([r["item"] for r in rows], np.int64), flat.dictionary, codes, starts)

    rows, held = [], 0
    for row in told.select("item", "terms").toLocalIterator():
        if rows and held + len(row["terms"]) > BLOCK_TERMS:
            yield packed(rows)
            rows, held = [], 0
        rows.append(row)
        held += len(row["terms"])
    if rows:
        yield packed(rows)


def term_counts(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, codes, counts) of every document with a term: all its terms, and its terms of the block."""
    bound = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bound.value
        width = len(vocabulary)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(sizes):
                owner, terms = terms_of(batch.column(1).slice(a, b - a))
                n = np.bincount(owner, minlength=b - a)
                code = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                known = code >= 0
                cell, count = np.unique(owner[known] * width + code[known], return_counts=True)
                bounds = np.searchsorted(cell, np.arange(b - a + 1) * width).astype(np.int32)
                told = [
                    batch.column(0).slice(a, b - a),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(cell % width, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(count, pa.int64())),
                ]
                found = pa.RecordBatch.from_arrays(told, names=["doc_id", "n", "codes", "counts"])
                yield found.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, counts array<long>")


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, one after another, and where each list begins."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def impact_vectors(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, codes, impacts, norm) of every document with a term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = lists(batch, "codes")
            counts, _ = lists(batch, "counts")
            sizes = np.diff(offsets)
            length = batch.column(1).to_numpy(zero_copy_only=False)
            m = np.repeat(10 + (90 * length * n_docs) // n_terms, sizes)
            impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * m)
            # Whole numbers: the running sum may wrap around, a document's own share of it is exact.
            squares = np.concatenate([[0], np.cumsum(impacts**2)])
            norm = np.sqrt(np.diff(squares[offsets]).astype(np.float64)) * (1 + ROOM)
            bounds = pa.array(offsets.astype(np.int32))
            told = [
                batch.column(0),
                pa.ListArray.from_arrays(bounds, pa.array(codes, pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(impacts, pa.int32())),
                pa.array(norm),
            ]
            yield pa.RecordBatch.from_arrays(told, names=["doc_id", "codes", "impacts", "norm"]).filter(pa.array(sizes > 0))

    return counted.mapInArrow(run, "doc_id long, codes array<int>, impacts array<int>, norm double")


@dataclass
class Search:
    """What a task needs of a block of items: weights by item, heaviest first, and thresholds."""

    numbers: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    focus: np.ndarray
    length: np.ndarray
    rest: np.ndarray
    least: np.ndarray
    top: int

    @classmethod
    def of(cls, items: Items, weight: np.ndarray, top: int) -> Search:
        n = len(items.numbers)
        owner = np.repeat(np.arange(n), np.diff(items.starts))
        order = np.lexsort((items.codes, -weight[items.codes], owner))
        codes = items.codes[order]
        weights = weight[codes]
        square = weights.astype(np.float64) ** 2
        total = np.add.reduceat(square, items.starts[:-1])
        running = np.cumsum(square) - np.repeat(np.cumsum(total) - total, np.diff(items.starts))
        inside = running - square < FOCUS * total[owner]
        focus = items.starts[:-1] + np.bincount(owner[inside], minlength=n)
        left = np.array([square[f:e].sum() for f, e in zip(focus, items.starts[1:])])
        return cls(items.numbers, codes, weights, items.starts, focus, np.sqrt(total), np.sqrt(left), np.ones(n, np.int64), top)


class Best:
    """The ``top`` documents of each item met so far, in order."""

    def __init__(self, search: Search):
        self.top = search.top
        self.least = search.least.copy()
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        if item in self.rows:
            score, doc, missing = (np.concatenate(x) for x in zip(self.rows[item], (score, doc, missing)))
        order = np.lexsort((doc, missing, -score))[: self.top]
        self.rows[item] = score[order], doc[order], missing[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], int(score[order[-1]]))


def search_bucket(search: Search, best: Best, norm, codes, impacts, offsets, doc, missing) -> None:
    """Add a bucket's documents to the best of all items that it may matter to."""
    rows = len(norm)
    longest = norm.max()
    alive = np.flatnonzero(search.length * longest * (1 + ROOM) >= best.least)
    if not len(alive):
        return
    # Postings of the bucket by term.
    order = np.argsort(codes, kind="stable")
    by_term, row, impact = codes[order], np.repeat(np.arange(rows), np.diff(offsets))[order], impacts[order].astype(np.int64)
    present, begin = np.unique(by_term, return_index=True)
    end = np.append(begin[1:], len(by_term))
    largest = np.maximum.reduceat(impact, begin)
    at = np.searchsorted(present, search.codes)
    at[at == len(present)] = 0
    known = present[at] == search.codes
    reach = np.where(known, search.weights * largest[at], 0)
    reachable = np.concatenate([[0], np.cumsum(reach)])
    squared = norm**2
    for q in alive.tolist():
        a, f, e = search.starts[q], search.focus[q], search.starts[q + 1]
        least = best.least[q]
        if reachable[e] - reachable[a] < least:
            continue
        partial, taken = np.zeros(rows), np.zeros(rows)
        for k in range(a, f):
            if known[k]:
                part = slice(begin[at[k]], end[at[k]])
                own = impact[part].astype(np.float64)
                partial[row[part]] += search.weights[k] * own
                taken[row[part]] += own**2
        left = search.rest[q] * np.sqrt(np.maximum(squared - taken, 0.0) + squared * ROOM)
        bound = partial + np.minimum(left, float(reachable[e] - reachable[f]))
        candidate = bound * (1 + ROOM) >= least
        if not candidate.any():
            continue
        score = np.zeros(rows, np.int64)
        for k in range(a, e):
            if known[k]:
                part = slice(begin[at[k]], end[at[k]])
                own = candidate[row[part]]
                # A document has one posting a term, so no row is there twice.
                score[row[part][own]] += search.weights[k] * impact[part][own]
        found = np.flatnonzero(candidate & (score >= least))
        if len(found):
            best.add(q, score[found], doc[found], missing[found])


def search_all(vectors: DataFrame, search: Search) -> DataFrame:
    """(item, doc_id, score): for each item the best documents of every task."""
    bound = vectors.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = bound.value
        best = Best(search)
        for batch in batches:
            for k in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(k, BUCKET_ROWS)
                codes, offsets = lists(part, "codes")
                impacts, _ = lists(part, "impacts")
                missing = part.column(0).is_null().to_numpy(zero_copy_only=False)
                doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                search_bucket(search, best, part.column(3).to_numpy(), codes, impacts, offsets, doc, missing)
        for q, (score, doc, missing) in best.rows.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), search.numbers[q])), pa.array(doc, pa.int64(), mask=missing), pa.array(score)],
                names=["item", "doc_id", "score"],
            )

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """(item, rank, doc_id, score): the best rows of each item, thinned out in groups of tasks first."""
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    grouped = found.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    part = Window.partitionBy("item", "_group").orderBy(*by_score)
    thinned = grouped.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= top).drop("_place", "_group")
    whole = Window.partitionBy("item").orderBy(*by_score)
    return thinned.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search_block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """Best documents of a block of items, written out."""
    counted = seal(term_counts(docs, items), "search-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequency = np.zeros(len(items.vocabulary), np.int64)
    # At most as many rows as the block has terms.
    for code, n in counted.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        frequency[code] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    search = Search.of(items, weight, top)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Copies have equal lengths: the row's number lets a range end among them.
    told = impact_vectors(counted, n_docs, n_terms or 1).withColumn("_row", F.monotonically_increasing_id())
    ranged = told.repartitionByRange(parts, F.desc("norm"), "_row").drop("_row")
    vectors = seal(ranged.sortWithinPartitions(F.desc("norm")), "search-vectors")
    release(counted)
    cut = vectors.agg(F.percentile_approx("norm", 1 - FIRST_SHARE)).first()[0]
    if cut is not None:
        first = best_of(search_all(vectors.where(F.col("norm") >= cut), search), top)
        place = {number: q for q, number in enumerate(items.numbers.tolist())}
        for row in first.where(F.col("rank") == top).select("item", "score").collect():
            search.least[place[row["item"]]] = row["score"]
    # Lengths that no item can reach its threshold with are left unread.
    floor = float((search.least / np.maximum(search.length, 1.0)).min()) * (1 - 2 * ROOM)
    found = seal(best_of(search_all(vectors.where(F.col("norm") >= floor), search), top), "search-found")
    release(vectors)
    return found


def search(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring rows of ``docs`` for each row of ``items``."""
    told = item_terms(items, item_key, text)
    rows = docs_and_texts(docs, key, text).select(F.col("doc_id").cast("bigint"), "text")
    found = None
    for block in item_blocks(told):
        own = search_block(rows, block, top)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    return found.join(told.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
