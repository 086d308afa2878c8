"""Connected components of a link table by alternating star contractions, all in joins and grouped minima.

Each round points every node's neighbours at its smallest neighbour (large star), then joins the smaller ones among
themselves (small star).  Rounds are written to the shared folder, so a lost executor costs a re-read; nothing of the
graph reaches the driver but two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.session import release, seal


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with v < u."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(down: DataFrame) -> DataFrame:
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def _state(down: DataFrame) -> tuple:
    return tuple(down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Self links and repeated links don't matter; null ends are ignored; no links give no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    down = seal(_downward(edges), "links")
    before = _state(down)
    while before[0]:
        large = seal(_downward(_large_star(down)), "links")
        small = seal(_downward(_small_star(large)), "links")
        release(large)
        release(down)
        down, after = small, _state(small)
        if after == before:
            break
        before = after
    # A fixed point is a set of stars: every node but the smallest points at the smallest.
    stars = down.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(heads)


def merge(head: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position known to be connected with each, after links (a, b) are added."""
    while True:
        least = np.minimum(head[a], head[b])
        if (head[a] == least).all() and (head[b] == least).all():
            return head
        for end in (a, b, head[a], head[b]):
            np.minimum.at(head, end, least)
        while (head[head] != head).any():
            head = head[head]
