"""Registry of named queries and the table access they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql_text: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql_text)
        return run

    return register


def queries() -> dict[str, Run]:
    return {name: q.run for name, q in QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (id, label, features array<double>)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


def r6(c: Column | str) -> Column:
    """Six decimals without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)


def long_form(rows: DataFrame, array: str | Column, *ids: str, name: str = "value") -> DataFrame:
    """One row per array slot: ids, pos, value."""
    return rows.select(*ids, F.posexplode(array).alias("pos", name)).select(
        *ids, F.col("pos").cast("bigint").alias("pos"), r6(name).alias(name)
    )


# SQL building blocks.

#: (id, label, pos, x) of the embeddings.
CELLS = """
cells AS (
  SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS pos,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
)"""

#: (doc, col, value) word counts of the documents.
TERMS = """
words AS (
  SELECT doc_id AS doc, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS col FROM documents
), terms AS MATERIALIZED (
  SELECT doc, col, CAST(count(*) AS DOUBLE) AS value FROM words WHERE col <> '' GROUP BY doc, col
)"""

#: Softmaxed word counts (doc, col, value), shifted by each document's largest count.
SOFTMAXED = (
    TERMS
    + """, tops AS MATERIALIZED (
  SELECT doc, max(value) AS top FROM terms GROUP BY doc
), raised AS MATERIALIZED (
  SELECT t.doc, t.col, exp(t.value - m.top) AS e FROM terms t JOIN tops m ON t.doc = m.doc
), sums AS MATERIALIZED (
  SELECT doc, sum(e) AS denominator FROM raised GROUP BY doc
), soft AS MATERIALIZED (
  SELECT t.doc, t.col, t.e / s.denominator AS value FROM raised t JOIN sums s ON t.doc = s.doc
)"""
)

#: The same by the literal formula; documents beyond its range are left out.
LITERALLY_SOFTMAXED = (
    TERMS
    + """, sums AS (
  SELECT doc, sum(exp(value)) AS denominator FROM terms
  WHERE doc IN (SELECT doc FROM terms GROUP BY doc HAVING max(value) <= 709) GROUP BY doc HAVING isfinite(sum(exp(value)))
), soft AS (
  SELECT t.doc, t.col, exp(t.value) / s.denominator AS value
  FROM terms t JOIN sums s ON t.doc = s.doc
)"""
)


def draw_sql(row_id: str, pos: str, seed: int, modulus: int = 1000) -> str:
    """The modular draw of ``functions.seeded.modular`` in SQL."""
    mixed = f"(({row_id} * 7919 + {pos} * 104729 + {seed}) % 1000003)"
    return f"(CAST(({mixed} * {mixed} + {mixed} * 31) % {modulus} AS DOUBLE) / CAST({modulus} AS DOUBLE))"
