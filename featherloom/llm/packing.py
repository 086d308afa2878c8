"""Best-fit packing: documents into sequences of bounded length, planned on the histogram of lengths.

Only lengths decide how documents fit, and there are at most ``size`` of them.  So the plan is made for counts of
lengths: best-two-fit fills a bin greedily, then replaces the bin's smallest document by two unpacked ones that fit the
expanded gap more tightly, and repeats the bin while the counts last.  The plan has a bound that depends on ``size``
alone; documents then look up their places by their rank within their length, found in two steps (counts per length
and bucket, ranks inside a bucket), so that no length meets in one task.

Defined results: a null text counts as empty and is one end id; an empty table gives no rows; equal rows are packed
each on their own; documents longer than ``size`` are cut, the last piece may be shorter; ties are ranked by
(doc_id, piece, crc); extra columns are not looked at; a null doc_id is packed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from featherloom.llm import tokens
from featherloom.llm.words import docs_and_texts, schema_with
from featherloom.session import seal

#: Tokens of a sequence.
SIZE = 4096

#: Rows that one rank bucket holds on average.
BUCKET_ROWS = 2_000_000

PIECES = schema_with(
    ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())
)

PLAN = schema_with(
    ("length", T.LongType()),
    ("from_rank", T.LongType()),
    ("to_rank", T.LongType()),
    ("first_sequence", T.LongType()),
    ("times", T.LongType()),
    ("first_offset", T.LongType()),
)


def pieces(docs: DataFrame, path: str, size: int = SIZE, table_words: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, cut where longer than ``size``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, table_words).encode
        for batch in batches:
            for a, texts in tokens.slices(batch.column(1)):
                ids, offsets = encode(texts)
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(texts)):
                    for n, begin in enumerate(range(offsets[i], offsets[i + 1], size)):
                        part = ids[begin : min(begin + size, offsets[i + 1])]
                        row.append(a + i)
                        piece.append(n)
                        start.append(n * size)
                        length.append(len(part))
                        crc.append(tokens.crc_of(part))
                columns = [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

    texts = docs_and_texts(docs).select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(cut, PIECES)


class Plan:
    """Bins for a histogram of lengths."""

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        self.size = size
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        #: (length, rank from, rank to, first sequence, times, first offset)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self._fill()

    def _fit(self) -> None:
        """Largest length still there that is not above x, for every x (0: none)."""
        self.fit = np.maximum.accumulate(np.where(self.left > 0, np.arange(self.size + 1), 0))

    def _bin(self) -> list[int]:
        """Lengths of the next bin: greedy, then its smallest document against two others."""
        used: dict[int, int] = {}

        def free(most: int) -> int:
            """Largest unpacked length up to ``most`` that this bin has not used up."""
            length = int(self.fit[most]) if most > 0 else 0
            while length and used.get(length, 0) >= self.left[length]:
                length = int(self.fit[length - 1])
            return length

        own: list[int] = []
        gap = self.size
        while gap and (length := free(gap)):
            own.append(length)
            used[length] = used.get(length, 0) + 1
            gap -= length
        while gap and len(own) > 1:
            smallest = own[-1]
            used[smallest] -= 1
            pair = self._two(gap + smallest, smallest, used)
            if pair is None:
                used[smallest] += 1
                break
            own[-1:] = pair
            for length in pair:
                used[length] = used.get(length, 0) + 1
            own.sort(reverse=True)
            gap = self.size - sum(own)
        return own

    def _two(self, room: int, beat: int, used: dict[int, int]) -> list[int] | None:
        """Two unpacked lengths that fill ``room`` best, if better than ``beat`` does."""
        left = self.left[: room + 1].copy()
        for length, n in used.items():
            if length <= room:
                left[length] -= n
        there = np.flatnonzero(left > 0)
        if not len(there):
            return None
        fit = np.maximum.accumulate(np.where(left > 0, np.arange(room + 1), 0))
        second = fit[room - there]
        # A length can't stand beside itself when only one is left: take the next smaller one.
        alone = (second == there) & (left[there] < 2)
        second[alone] = fit[there[alone] - 1]
        total = np.where(second > 0, there + second, 0)
        best = int(np.argmax(total))
        return [int(there[best]), int(second[best])] if total[best] > beat else None

    def _fill(self) -> None:
        taken = np.zeros(self.size + 1, np.int64)
        self._fit()
        while self.fit[self.size]:
            own = self._bin()
            uses: dict[int, int] = {}
            for length in own:
                uses[length] = uses.get(length, 0) + 1
            times = int(min(self.left[length] // n for length, n in uses.items()))
            offset = 0
            for length in own:
                at = int(taken[length])
                self.rows.append((length, at, at + times, self.sequences, times, offset))
                taken[length] += times
                offset += length
            for length, n in uses.items():
                self.left[length] -= n * times
            self.sequences += times
            self._fit()


def ranked(rows: DataFrame, total: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with their rank (from 0) within their length, no length in one task.

    Buckets are hashes of the document; a count per (length, bucket) gives each bucket's first rank.
    """
    buckets = max(1, -(-total // bucket_rows))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(first, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("inside"))
        .drop("bucket", "first", "inside")
    )


def pack(cut: DataFrame, size: int = SIZE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  ``cut`` should be a written table: it is read three times."""
    spark = cut.sparkSession
    #: At most ``size`` rows: one for each length.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, size)
    #: Rows of the plan: at most a few for each of ``size`` lengths, whatever the data.
    places = F.broadcast(spark.createDataFrame(plan.rows, PLAN))
    rank = ranked(cut, sum(counts.values()), bucket_rows)
    at = rank.join(
        places, (rank["length"] == places["length"]) & (rank["rank"] >= F.col("from_rank")) & (rank["rank"] < F.col("to_rank"))
    ).drop(places["length"])
    return at.select(
        *PIECES.names,
        (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
        F.col("first_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, table_words: int | None = None) -> DataFrame:
    """Tokenize, cut and pack whole documents; ``table_words`` bounds the word table of a task."""
    return pack(seal(pieces(docs, path, size, table_words), "pieces"), size)
