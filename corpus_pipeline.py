"""A training corpus from raw documents in five stages, each one operator of ``featherloom.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm import line_dedup, minhash, mixing, packing, quality, queries, tokens
from featherloom.session import scratch_path

#: One epoch: the near-duplicate stage has just removed copies, and the mix brings none back.
MIX = mixing.MixSettings(weights=queries.WEIGHTS, share=0.8, epochs=1)

#: Short lines too: menus, buttons and bylines recur, and left alone they keep a stub of every copy.
LINES = line_dedup.LineSettings(min_tokens=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality.learn(docs, queries.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template occurred in an earlier document; texts left without a word go."""
    clean, counts = line_dedup.dedupe(docs, LINES)
    emptied = (F.col(counts)["n_dropped"] > 0) & ~F.col("text").rlike(line_dedup.WORD)
    clean = clean.where(~emptied).drop(counts)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in clean.columns else clean


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for the target weights of domains, languages and sources."""
    taken, _ = mixing.mix(queries.with_domain(docs), MIX)
    return taken.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 tokens."""
    # Earlier stages have left their executors fuller: a smaller word table.
    return packing.pack_documents(docs, tokens.vocabulary(), table_words=400_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Packing works on tokenizer ids, which SQL can't make.
ORACLE_SQL = None
