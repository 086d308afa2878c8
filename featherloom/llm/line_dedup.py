"""Line dedup by log templates: a fixed-depth tree over token count, leading tokens and generalised fields.

A line is a run between newlines; its tokens are its words.  Tokens that hold a digit, an ``@`` or ``://`` are variable
fields and become ``<*>``.  The tree's levels are the number of tokens, the ``depth`` leading tokens, which are never
generalised, and the rest, of which one of ``blocks`` contiguous parts may be generalised as a whole; so two
lines in one leaf differ in at most that part.  Lines too short for that are leaves with their fields masked; lines of
which over a third is variable are no templates and stand for themselves, word for word.  A template that
occurs in two documents or more recurs, and of its lines only the first, by (doc_id, place), stays.

All of it is DataFrame expressions and joins on 96-bit hashes of the templates.  First and last document of a template
are combined before the shuffle, so a line that every document has costs one row per task.

Defined results: a null text counts as empty and stays as it is; lines without words or with fewer than ``min_tokens``
are never dropped; repeated rows of a document are the same document, each loses the same lines; texts of rows that share
a doc_id count as one document; null doc_ids count as one document before all others; an empty table gives no
rows; extra columns are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.llm.words import WORD, free_name, let, text_of, words_of
from featherloom.session import seal

#: Marks a variable field; WORD, imported above, is what a token is.
VARIABLE = r"[0-9]|@|://"
WILD = "<*>"

#: Stands for a null doc_id.
NO_ID = -(2**63)


@dataclass(frozen=True)
class LineSettings:
    """depth: leading tokens kept as they are; blocks: parts of the rest, one may vary.

    min_tokens: shorter lines are left alone; min_general: shorter lines are templates as they are.
    """

    depth: int = 2
    blocks: int = 4
    min_tokens: int = 5
    min_general: int = 8


def masked(line: Column, words: Column) -> Column:
    """Tokens of a line with variable fields masked."""
    hidden = F.transform(words, lambda w: F.when(w.rlike(VARIABLE), F.lit(WILD)).otherwise(w))
    return F.when(line.rlike(VARIABLE), hidden).otherwise(words)


def line_templates(line: Column, settings: LineSettings) -> Column:
    """Templates of a line, null if it is too short to have any."""

    def of_words(words: Column) -> Column:
        own = F.array(F.concat_ws(" ", F.size(words).cast("string"), F.lit("="), words))

        def of_tokens(tokens: Column) -> Column:
            variable = F.size(F.filter(tokens, lambda t: t == WILD))
            return F.when(3 * variable > F.size(tokens), own).otherwise(templates(tokens, settings))

        return F.when(F.size(words) >= settings.min_tokens, let(masked(line, words), of_tokens))

    return let(words_of(line), of_words)


def templates(tokens: Column, settings: LineSettings = LineSettings()) -> Column:
    """Array of the templates (text) that a line's masked tokens lead to in the tree."""
    n = F.size(tokens)
    rest = n - settings.depth

    def general(j: int) -> Column:
        begin = settings.depth + F.floor(rest * j / settings.blocks).cast("int")
        end = settings.depth + F.floor(rest * (j + 1) / settings.blocks).cast("int")
        return F.concat_ws(
            " ", n.cast("string"), F.lit(str(j)), F.slice(tokens, F.lit(1), begin), F.lit(WILD), F.slice(tokens, end + 1, n)
        )

    exact = F.array(F.concat_ws(" ", n.cast("string"), F.lit("-"), tokens))
    return F.when(n < settings.min_general, exact).otherwise(F.array(*(general(j) for j in range(settings.blocks))))


def with_templates(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """(doc, text_hash, line, template) of every line that may be dropped."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text_of("text")).alias("text_hash"),
        F.posexplode(F.split(text_of("text"), "\n")).alias("line", "raw"),
    )
    return rows.select("doc", "text_hash", "line", F.explode(line_templates(F.col("raw"), settings)).alias("template"))


def recurring(keys: DataFrame, *by: str) -> DataFrame:
    """(by, first) of templates found in two documents or more; ``first`` is the line that stays."""
    found = keys.groupBy(*by).agg(
        F.min(F.struct("doc", "text_hash", "line")).alias("first"), F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    return found.where("low != high").drop("low", "high")


def report(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """(template, documents, lines) of the recurring templates."""
    lines = with_templates(docs, settings)
    per_doc = lines.groupBy("template", "doc").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("lines")).where("documents > 1")


def dropped_lines(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """(doc, text_hash, dropped) of the texts that lose lines; ``dropped`` has the places of the lines."""
    lines = with_templates(docs, settings)
    keys = seal(
        lines.select("doc", "text_hash", "line", F.xxhash64("template").alias("k"), F.hash("template").alias("k2")), "line-keys"
    )
    again = keys.join(recurring(keys, "k", "k2"), ["k", "k2"]).where(F.struct("doc", "text_hash", "line") != F.col("first"))
    return again.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("dropped"))


def dedupe(docs: DataFrame, settings: LineSettings = LineSettings()) -> tuple[DataFrame, str]:
    """``docs`` without the recurring lines, and one more column, whose name is returned: (n_lines, n_dropped)."""
    name = free_name(docs, "line_counts")
    lost = dropped_lines(docs, settings).toDF("_ld_doc", "_ld_hash", "_ld_dropped")
    found = docs.join(
        lost,
        (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)) == F.col("_ld_doc")) & (F.xxhash64(text_of("text")) == F.col("_ld_hash")),
        "left",
    )

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_dropped"))
        return F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")

    lines = F.split(F.col("text"), "\n")
    text = F.when(F.col("_ld_dropped").isNull(), F.col("text")).otherwise(let(lines, rest))
    counts = F.struct(
        F.size(F.split(text_of("text"), "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_ld_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return found.select(*columns, counts.alias(name)), name
