"""Queries on the documents, their labels and the order lines as integer triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.catalog.registry import LITERALLY_SOFTMAXED, TERMS, query, r6, table
from featherloom.operators import documents, joins, metrics, pairs, scaling
from featherloom.session import scratch_path
from featherloom.sources import tables


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.term_triples(table(spark, sf_dir, "documents"))


def softmaxed(spark: SparkSession, sf_dir: str, stable: bool = False) -> DataFrame:
    """The words of the documents, softmaxed."""
    return scaling.softmaxed_terms(*documents.term_rows(table(spark, sf_dir, "documents")), stable)


def order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, parts as columns, both 1-based: (doc, col, value)."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("doc"),
        (F.col("l_partkey") + 1).alias("col"),
        F.col("l_quantity").alias("value"),
    )


@query(
    """
SELECT word, count(*) AS n FROM (
  SELECT unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word FROM documents
) GROUP BY word"""
)
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.word_count(table(spark, sf_dir, "documents"), "text", documents.WHITESPACE)


@query(
    """
SELECT word, count(*) AS n FROM (
  SELECT unnest(string_split(text, chr(9))) AS word FROM conversations
) GROUP BY word"""
)
def tab_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.word_count(table(spark, sf_dir, "conversations"), "text")


@query(f"WITH {TERMS} SELECT doc, col, value FROM terms")
def doc_term_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir)


@query(
    """
WITH cells AS (
  SELECT l_orderkey + 1 AS doc, l_partkey + 1 AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2
)
SELECT doc, CAST(floor(col / 4096) AS INTEGER) AS part, count(*) AS n_words,
       string_agg(CAST(col AS VARCHAR) || ':' || CAST(CAST(value AS BIGINT) AS VARCHAR), ' ' ORDER BY col) AS words
FROM cells GROUP BY 1, 2"""
)
def grouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = documents.drop_empty(documents.group_documents(order_triples(spark, sf_dir)))
    text = F.transform("words", lambda w: F.concat(w["col"], F.lit(":"), w["value"].cast("bigint")))
    return documents.sorted_by_document(grouped).select(
        "doc", "part", F.size("words").cast("bigint").alias("n_words"), F.concat_ws(" ", text).alias("words")
    )


@query(
    """
SELECT max(l_orderkey) + 1 AS rows, max(l_partkey) + 1 AS cols, count(*) AS entries FROM lineitem"""
)
def matrix_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.matrix_extent(order_triples(spark, sf_dir))


@query(
    """
SELECT count(DISTINCT l_orderkey) AS docs, max(l_partkey) + 1 AS cols FROM lineitem"""
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.dataset_stats(order_triples(spark, sf_dir))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LITERALLY_SOFTMAXED} SELECT doc, col, round(value, 6) + 0.0 AS value FROM soft")
def doc_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmaxed(spark, sf_dir).withColumn("value", r6("value"))


@query(
    f"""
WITH {TERMS}, per_doc AS (SELECT doc, max(value) AS top FROM terms GROUP BY doc)
SELECT count(*) AS documents, count(*) FILTER (WHERE top > 709) AS left_out FROM per_doc"""
)
def doc_softmax_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the literal softmax leaves out."""
    return scaling.left_out(terms(spark, sf_dir))


@query(
    f"""
WITH {TERMS}, tops AS (SELECT doc, max(value) AS top FROM terms GROUP BY doc),
shifted AS (SELECT t.doc, t.col, exp(t.value - m.top) AS e FROM terms t JOIN tops m ON t.doc = m.doc)
SELECT doc, col, round(e / sum(e) OVER (PARTITION BY doc), 6) + 0.0 AS value FROM shifted"""
)
def doc_softmax_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmaxed(spark, sf_dir, stable=True).withColumn("value", r6("value"))


@query(
    """
SELECT d.doc_id AS doc, d.lang, l.quality + 1 - 1 AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
)
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    raw = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), (F.col("quality") + 1).alias("label"))
    return joins.label_rows(docs, raw.withColumn("label", joins.shifted_label("label")))


@query(
    """
WITH ordered AS (SELECT toxic, row_number() OVER (ORDER BY doc_id) AS doc FROM labels)
SELECT o.doc, o.toxic AS label, d.source FROM ordered o JOIN documents d ON d.doc_id = o.doc"""
)
def positional_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as one number per line and joined back by line number."""
    path = scratch_path(spark, "labels")
    lines = table(spark, sf_dir, "labels").orderBy("doc_id").select((F.col("toxic") + 1).cast("string"))
    lines.write.text(path)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    return joins.label_rows(docs, tables.read_labels(spark, path)).select("doc", "label", "source")


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (0, 1)")
def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.illegal_labels(table(spark, sf_dir, "embeddings")).select("vec_id", "label")


@query(
    """
WITH cells AS (
  SELECT l_orderkey + 1 AS doc, l_partkey + 1 AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2
)
SELECT doc, col - 1 AS slot, value FROM cells"""
)
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ml sparse vectors, part by part, read back from the indices they store."""
    triples = order_triples(spark, sf_dir)
    size = triples.agg(F.max("col")).first()[0]
    return documents.stored_cells(documents.sparse_vectors(documents.group_documents(triples), size))


@query(
    """
SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, value AS current
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1"""
)
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.consecutive_pairs(table(spark, sf_dir, "events"), "user_id", "event_id", "value", span=1024)


@query(
    """
WITH p AS (SELECT event_type, sum(value) AS w FROM events WHERE user_id % 2 = 0 GROUP BY 1),
q AS (SELECT event_type, sum(value) AS w FROM events WHERE user_id % 2 = 1 GROUP BY 1),
n AS (SELECT p.w / (SELECT sum(w) FROM p) AS p, q.w / (SELECT sum(w) FROM q) AS q
      FROM p JOIN q ON p.event_type = q.event_type)
SELECT round(sum(p * ln(p / q)), 6) + 0.0 AS kl_pq, round(sum(q * ln(q / p)), 6) + 0.0 AS kl_qp,
       round(sum(p * ln(p / q)) + sum(q * ln(q / p)), 6) + 0.0 AS symmetric_kl
FROM n"""
)
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event mix of even and odd users compared."""
    events = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 2).alias("side"))
    found = metrics.divergences(events.where("side = 0"), events.where("side = 1"), "event_type", "value")
    return found.select(*[r6(c).alias(c) for c in found.columns])
