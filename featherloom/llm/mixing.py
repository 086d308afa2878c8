"""Mixing sources to target weights: token budgets handed down a tree of domains, languages and sources.

A node's budget goes to its children by their weights; what a child can't fill goes to its siblings, again by weight, and
only what all of them can't fill goes back to their parent's siblings.  Handing down from the root with every node's capacity
(its tokens times ``epochs``) as its bound is just that rule.  A leaf with more budget than tokens is taken whole for
as many epochs as fit; the rest is the token-prefix of one more epoch in an order drawn from (seed, epoch, doc_id).

The tree is a table and each level one window over siblings.  The prefix of a leaf is found in two steps, token sums of
4096 slices of the drawn order, then the documents of the slice the budget ends in; so a source with a third of all
rows is no task's burden.  Documents are then compared with their leaf's last draw, and no text is shuffled.

Defined results: a null text has no tokens; null levels are a value of their own (empty); a prefix holds whole
documents and never exceeds its budget; documents without tokens are taken with those drawn before them, and a leaf
without tokens is taken once; rows that share a doc_id in a leaf are drawn together; a value without a weight has weight ``other``, and weight 0 takes nothing; an
empty table gives no rows; extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.words import WORD, free_name, text_of
from featherloom.session import seal

#: Most leaves whose table is broadcast (about 200 bytes each); beyond it Spark joins by key and splits hot ones.
BROADCAST_LEAVES = 50_000

HEX = 3  #: Hexadecimal digits of a draw that name its slice.


@dataclass(frozen=True)
class MixSettings:
    """levels: columns of the tree from the root down; weights: per level the weights of its values.

    share: tokens to take, as a share of all tokens there are; tokens: the same as a number, if given.
    epochs: how often a document may be taken.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.75
    tokens: int | None = None
    epochs: int = 2
    seed: int = 17


def weight_of(level: str, value: Column, settings: MixSettings) -> Column:
    own = settings.weights.get(level, {})
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), own.items(), F.when(F.lit(False), 0.0)).otherwise(settings.other).cast("double")


def counted(docs: DataFrame, settings: MixSettings) -> DataFrame:
    """(doc_id, levels, n_tokens) of every row; tokens are words."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in settings.levels),
        F.regexp_count(text_of("text"), F.lit(WORD)).cast("bigint").alias("n_tokens"),
    )


def budgets(leaves: DataFrame, settings: MixSettings) -> DataFrame:
    """(levels, supply, budget) of each leaf from (levels, supply).

    Capacities count from the leaves up: what lies under a weight of 0 can't be taken, so no node has a budget for it.
    """
    levels = list(settings.levels)
    taken = reduce(lambda a, b: a & b, [weight_of(level, F.col(level), settings) > 0 for level in levels])
    leaves = leaves.withColumn("usable", F.when(taken, F.col("supply") * settings.epochs).otherwise(0))
    capacity = F.col("usable").cast("double")
    wanted = F.lit(settings.tokens) if settings.tokens is not None else F.sum("supply") * settings.share
    parents = leaves.agg(F.least(F.sum(capacity), F.floor(wanted).cast("double")).alias("budget"))
    for k, level in enumerate(levels):
        above, own = levels[:k], levels[: k + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("usable").alias("usable")).withColumn("weight", weight_of(level, F.col(level), settings))
        met = nodes.join(parents, above) if above else nodes.crossJoin(F.broadcast(parents))
        siblings = Window.partitionBy(*above)
        # Those that fill up first come first: capacity over weight.
        order = siblings.orderBy(F.when(F.col("weight") > 0, capacity / F.col("weight")).asc_nulls_last(), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("budget") - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))
        weights_left = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        met = met.withColumn("full", (F.col("weight") > 0) & (capacity * weights_left <= left * F.col("weight")))
        open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(siblings)
        spent = F.sum(F.when(F.col("full"), capacity).otherwise(0.0)).over(siblings)
        part = F.when(open_weight > 0, (F.col("budget") - spent) * F.col("weight") / open_weight).otherwise(0.0)
        given = F.when(F.col("full"), capacity).otherwise(F.greatest(F.lit(0.0), F.least(capacity, part)))
        parents = met.withColumn("given", given).select(*own, F.col("given").alias("budget"))
    return leaves.join(parents, levels).select(*levels, "supply", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget"))


def draw(doc_id: Column, epoch: Column, settings: MixSettings) -> Column:
    """Place of a document in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(settings.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cuts(rows: DataFrame, settings: MixSettings) -> DataFrame:
    """(levels, budget, whole, cut): epochs taken whole, and the first draw of the next that is not taken (null: none)."""
    levels = list(settings.levels)
    leaves = seal(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply")), "leaves")
    whole = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("bigint")
    plan = seal(
        budgets(leaves, settings)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply"))
        .withColumn("open", (F.col("rest") > 0) | (F.col("supply") == 0)),
        "budgets",
    )
    open_plan = plan.where("open").select(*levels, "whole", "rest")
    small = plan.count() <= BROADCAST_LEAVES
    drawn = rows.join(F.broadcast(open_plan) if small else open_plan, levels)
    drawn = drawn.withColumn("draw", draw(F.col("doc_id"), F.col("whole"), settings))
    one = seal(drawn.groupBy(*levels, "rest", "draw").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("slice", F.substring("draw", 1, HEX)), "draws")
    slices = one.groupBy(*levels, "rest", "slice").agg(F.sum("n_tokens").alias("n"))
    ordered = Window.partitionBy(*levels).orderBy("slice")
    earlier = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The first slice that doesn't fit whole is the one the budget ends in.
    last = (
        slices.withColumn("earlier", earlier)
        .where(F.col("earlier") + F.col("n") > F.col("rest"))
        .groupBy(*levels)
        .agg(F.min(F.struct("slice", "earlier")).alias("s"))
        .select(*levels, F.col("s.slice").alias("slice"), F.col("s.earlier").alias("earlier"))
    )
    inside = Window.partitionBy(*levels).orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    ends = one.join(F.broadcast(last) if small else last, [*levels, "slice"])
    first_out = (
        ends.withColumn("sum", F.col("earlier") + F.sum("n_tokens").over(inside))
        .where(F.col("sum") > F.col("rest"))
        .groupBy(*levels)
        .agg(F.min("draw").alias("cut"))
    )
    # Nothing comes before the empty draw.
    cut = F.when(F.col("open"), F.col("cut")).otherwise("").alias("cut")
    return seal(plan.join(first_out, levels, "left").select(*levels, "budget", "whole", cut), "cuts")


def mix(docs: DataFrame, settings: MixSettings, counts: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Rows of ``docs`` as often as they are taken, and one more column, whose name is returned: the epoch.

    ``docs`` has the level columns and doc_id; ``counts`` is :func:`counted` of it, if already at hand.
    """
    levels = list(settings.levels)
    rows = seal(counted(docs, settings), "token-counts") if counts is None else counts
    plan = cuts(rows, settings)
    renamed = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in plan.columns))
    small = plan.count() <= BROADCAST_LEAVES
    same = [F.coalesce(docs[c].cast("string"), F.lit("")) == F.col(f"_mix_{c}") for c in levels]
    found = docs.join(F.broadcast(renamed) if small else renamed, reduce(lambda a, b: a & b, same))
    here = draw(F.col("doc_id").cast("bigint"), F.col("_mix_whole"), settings)
    more = F.col("_mix_cut").isNull() | (here < F.col("_mix_cut"))
    times = F.col("_mix_whole") + more.cast("int")
    name = free_name(docs, "epoch")
    taken = found.where(times > 0).withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    return taken.select(*(docs[c] for c in docs.columns), F.col(name).cast("int").alias(name)), name
