"""Token ids in Parquet list columns: ascending documents, delta encoding, small row groups, page indexes.

A store is a folder of Parquet files with one row per document: (doc_id, n_tokens, ids, shard).  Documents are
range-partitioned and sorted, so footers and page indexes give narrow doc_id ranges, and a read of some documents or of
the metadata columns alone touches few pages.  Version-2 pages write ids with a dictionary, and fall back to delta
encoding where the dictionary grows too large; lengths and doc_ids are delta encoded.

Defined results: a null text counts as empty and is one end id; repeated rows are written each, in any order among
equals; null doc_ids come first; an empty table gives an empty store; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from featherloom.llm.token_counts import slices
from featherloom.llm.word_table import word_table
from featherloom.llm.words import docs_and_texts, schema_with

STORE = schema_with(("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType(), False)))
STORED = T.StructType([*STORE.fields, T.StructField("shard", T.IntegerType())])


@dataclass(frozen=True)
class StoreSettings:
    """Layout of the files: encoding of the ids, and sizes of row groups and pages in bytes.

    encoding: "dictionary" (falls back to delta where the dictionary grows too large) or "delta".
    """

    encoding: str = "dictionary"
    row_group_bytes: int = 16 * 1024 * 1024
    page_bytes: int = 256 * 1024
    page_rows: int = 2_000

    def options(self) -> dict[str, str]:
        return {
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": str(self.encoding == "dictionary").lower(),
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#n_tokens": "false",
            "parquet.dictionary.page.size": str(1024 * 1024),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "compression": "zstd",
        }


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of whole texts, the end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(sizes):
                ids, offsets = table.encode(batch.column(1).slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), lists], names=STORE.names
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, STORE)


def write(docs: DataFrame, path: str, vocabulary: str, settings: StoreSettings = StoreSettings(), shards: int | None = None) -> None:
    """Write the ids of ``docs`` in ascending doc_id order as a store.

    The texts are range-partitioned before they are tokenized: they are smaller than their ids, and each
    is tokenized once.  ``shards`` is the number of ranges (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs_and_texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    rows = tokenized(ranged, vocabulary).withColumn("shard", F.spark_partition_id())
    rows.write.options(**settings.options()).mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a store; naming only metadata columns leaves the ids on disk."""
    rows = spark.read.schema(STORED).parquet(path)
    return rows.select(*columns) if columns else rows


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Documents with low <= doc_id <= high; row groups and pages outside are skipped."""
    return read(spark, path).where(F.col("doc_id").between(low, high))


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store, from what its files hold.

    ``start`` counts the ids of all documents before: the sizes of the shards come from a read of two metadata
    columns, the place inside a shard from a window over its documents.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "n_tokens", "ids_crc32"],
            )

    totals = read(spark, path, ["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = read(spark, path, ["doc_id", "shard", "ids"]).mapInArrow(
        digest, "doc_id long, shard int, n_tokens long, ids_crc32 long"
    )
    before = Window.partitionBy("shard").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(first, "shard").select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
