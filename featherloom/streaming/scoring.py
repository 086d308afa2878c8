"""Fitted models applied to a stream.

Scoring is a projection, so it needs no state, watermark or shuffle: the batch
code runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def vector_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_to_files(stream: DataFrame, score, output: str, progress: str) -> StreamingQuery:
    """Apply ``score`` (rows -> rows) and append the result as Parquet, exactly once.

    ``progress`` is the checkpoint folder that belongs to ``output``: a later run with both goes on where this one
    stopped.  With another folder the sink would take its first batches for ones it has written and leave them out.
    """
    return (
        score(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(output)
    )
