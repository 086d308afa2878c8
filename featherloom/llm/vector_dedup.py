"""Embedding near duplicates: int8 tile products with proven error bounds, full precision where a bound leaves doubt.

Equal vectors of a label are one class.  The classes of a label are dealt by hash to tiles of bounded size; every pair
of tiles meets in one task.  There both tiles are normalised and quantised to int8; the product of the quantised tiles
is exact in float32 up to 1040 components (beyond them what float32 may lose is added to the bound), and for each vector the norm of its quantisation error is known:

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|

so only pairs whose approximate cosine plus that bound reaches the threshold are computed again in double precision.  A
task returns a count of links for each class and, instead of its links, what each row is connected with: its output
grows with the rows of the tiles, not with the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label, have no links and are their own component; vectors of different length are never linked; equal vectors are
always linked; repeated ids get a row each; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.components import components, merge
from featherloom.session import release, seal


@dataclass(frozen=True)
class VectorSettings:
    """least: cosine that links; tile: classes of a tile on average."""

    least: float = 0.93
    tile: int = 4096


#: Allowance for the rounding of float32 and float64 sums, added to each bound.
ROUNDING = 1e-5

#: Components whose int8 products add up below 2**24, so exactly in float32.
EXACT_WIDTH = 2**24 // 127**2


def allowance(width: int) -> float:
    """Rounding to allow for in a product of ``width`` components: a float32 sum of that many terms may lose width * 2**-24."""
    return ROUNDING + (0.0 if width <= EXACT_WIDTH else 1.1 * width * 2.0**-24)


#: Rows of a block of the product inside a task.
BLOCK = 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows (as float32), their scales, the norms of what they stand for, and the norms of their errors."""
    top = np.abs(unit).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top / 127.0, 1.0)
    q = np.rint(unit / scale[:, None])
    stands = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(stands, axis=1), np.linalg.norm(unit - stands, axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; scaled first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, least: float, sizes_left: np.ndarray, sizes_right: np.ndarray):
    """Links between the rows of two tiles (or inside one): weighted counts of both sides, and heads.

    Counts weigh a partner class by its size.  ``heads`` gives each row, those of the right tile after those of
    the left, the first row that a chain of these links connects it with.
    """
    ql, sl, nl, el = quantised(left)
    qr, sr, _, er = (ql, sl, nl, el) if same else quantised(right)
    count_left, count_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    head = np.arange(len(left) + (0 if same else len(right)))
    for begin in range(0, len(left), BLOCK):
        end = min(begin + BLOCK, len(left))
        about = (ql[begin:end] @ qr.T) * (sl[begin:end, None] * sr[None, :])
        bound = el[begin:end, None] + nl[begin:end, None] * er[None, :]
        i, j = np.nonzero(about + bound >= least - allowance(left.shape[1]))
        i += begin
        if same:
            upper = i < j
            i, j = i[upper], j[upper]
        for part in range(0, len(i), 1 << 18):
            a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            linked = np.einsum("ij,ij->i", left[a], right[b]) >= least
            a, b = a[linked], b[linked]
            np.add.at(count_left, a, sizes_right[b])
            np.add.at(count_right, b, sizes_left[a])
            head = merge(head, a, b if same else b + len(left))
    return count_left, count_right, head


def links(classes: DataFrame, settings: VectorSettings = VectorSettings()) -> DataFrame:
    """(id, n, other) from classes (label, width, id, size, vector).

    Rows with a count have a null ``other``; rows with ``other`` say that the two are connected.
    """
    per_label = classes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("members"))
    dealt = classes.join(per_label, ["label", "width"]).withColumn("tiles", F.ceil(F.col("members") / settings.tile).cast("int"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "width", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "size", "vector"
    )
    least = settings.least

    def product(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        tile = group.column("tile").to_numpy()
        ids, sizes = group.column("id").to_numpy(), group.column("size").to_numpy()
        width = group.column("width")[0].as_py()
        flat = group.column("vector").combine_chunks()
        unit = unit_rows(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
        a, b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        if low == high:
            counts, more, head = tile_links(unit[a], unit[a], True, least, sizes[a], sizes[a])
            total, who = counts + more, ids[a]
        else:
            counts, more, head = tile_links(unit[a], unit[b], False, least, sizes[a], sizes[b])
            total, who = np.concatenate([counts, more]), np.concatenate([ids[a], ids[b]])
        some = np.flatnonzero(total)
        led = np.flatnonzero(head != np.arange(len(head)))
        return pa.table(
            {
                "id": np.concatenate([who[some], who[led]]),
                "n": np.concatenate([total[some], np.zeros(len(led), np.int64)]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(who[head[led]], pa.int64())]),
            }
        )

    return met.groupBy("label", "width", "low", "high").applyInArrow(product, "id long, n long, other long")


def near_duplicates(
    rows: DataFrame, settings: VectorSettings = VectorSettings(), key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    clean = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("bigint").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("label").isNotNull() & F.coalesce(
        F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    #: Written once: row numbers must not change between the reads below.
    own = seal(clean.withColumn("vector", F.when(sound, F.col("vector"))), "vectors")
    usable = own.where(F.col("vector").isNotNull())
    classes = seal(
        usable.groupBy("label", "vector").agg(F.min("row").alias("id"), F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("size"))
        .withColumn("width", F.size("vector")),
        "vector-classes",
    )
    found = seal(links(classes, settings), "vector-links")
    counts = found.where(F.col("other").isNull()).groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where(F.col("other").isNotNull()), "id", "other").withColumnRenamed("node", "id")
    told = (
        classes.select("label", "vector", "id", "smallest", "size")
        .join(counts, "id", "left")
        .join(groups, "id", "left")
        .withColumn("own", F.coalesce("component", "id"))
    )
    smallest = told.groupBy("own").agg(F.min("smallest").alias("component_id"))
    named = told.join(smallest, "own").select(
        "label", "vector", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    out = (
        own.join(named, ["label", "vector"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
    out = seal(out, "vector-groups")
    for done in (own, classes, found):
        release(done)
    return out
