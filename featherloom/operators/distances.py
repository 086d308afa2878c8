"""The nearest of a table of centres for every row, without the table of all pairs.

Squared distances come from norms and one matrix product per tile of centres, |a|^2 + |b|^2 - 2ab.  That loses digits where
two vectors are close, so each has a bound on its error; pairs that may be the nearest within their bounds are computed
again from the differences, and those exact values decide.  Usually that is one pair a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.operators import joins
from featherloom.operators.order import numbered
from featherloom.session import release, seal

#: Rows and centres that meet in one matrix product.
BLOCK = 1024

#: Bytes of differences held at once.
PAIR_BYTES = 64 << 20


@dataclass
class Centres:
    """A tile of centres: keys in ascending order, vectors, squared norms."""

    keys: pa.Array
    vectors: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Centres:
        rows = rows.sort_by("centre")
        width = len(rows.column("vector")[0]) if len(rows) else 0
        flat = rows.column("vector").combine_chunks().flatten().to_numpy()
        if len(flat) != width * len(rows):
            raise ValueError("centres have different lengths")
        vectors = flat.reshape(len(rows), width)
        return cls(rows.column("centre").combine_chunks(), vectors, (vectors**2).sum(axis=1))


def error_bound(width: int, squares: np.ndarray) -> np.ndarray:
    """Largest rounding error of |a|^2 + |b|^2 - 2ab in double precision, ``squares`` being |a|^2 + |b|^2."""
    return (width + 4) * np.finfo(np.float64).eps * squares


def nearest_of(x: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre and the squared distance, for finite rows; of equal distances the first centre's."""
    best, place = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    width = x.shape[1]
    own = (x**2).sum(axis=1)
    for a in range(0, len(x), BLOCK):
        part = slice(a, a + BLOCK)
        for c in range(0, len(centres.norms), BLOCK):
            tile = slice(c, c + BLOCK)
            squares = own[part, None] + centres.norms[None, tile]
            fast = squares - 2.0 * (x[part] @ centres.vectors[tile].T)
            room = error_bound(width, squares)
            reach = np.minimum((fast + room).min(axis=1), best[part])
            i, j = np.nonzero(fast - room <= reach[:, None])
            step = max(1, PAIR_BYTES // (8 * max(width, 1)))
            exact = np.concatenate(
                [((x[a + i[k : k + step]] - centres.vectors[c + j[k : k + step]]) ** 2).sum(axis=1) for k in range(0, len(i), step)] or [np.zeros(0)]
            )
            order = np.lexsort((j, exact, i))
            first = order[np.concatenate([[True], np.diff(i[order]) != 0])] if len(order) else order
            closer = first[exact[first] < best[a + i[first]]]
            best[a + i[closer]], place[a + i[closer]] = exact[closer], c + j[closer]
    return place, best


def with_nearest(rows: DataFrame, centres: Centres, features: str, kind: str) -> DataFrame:
    """``rows`` with ``nearest`` and ``distance`` brought up to date by a tile of centres."""
    bound = rows.sparkSession.sparkContext.broadcast(centres)
    known = "nearest" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = bound.value
        width = centres.vectors.shape[1]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(batch.schema.get_field_index(features))
            sizes = pc.list_value_length(column).fill_null(-1).to_numpy()
            if ((sizes >= 0) & (sizes != width)).any():
                raise ValueError("rows and centres have different lengths")
            there = np.flatnonzero(sizes == width)
            flat = column.take(pa.array(there)).flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), width)
            finite = np.isfinite(x).all(axis=1)
            there, x = there[finite], x[finite]
            place, distance = nearest_of(x, centres)
            near, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            near[there], far[there] = place, distance
            keys = centres.keys.take(pa.array(near, mask=near < 0))
            told = pa.array(far, mask=near < 0)
            names = [n for n in batch.schema.names if n not in ("nearest", "distance")]
            if known:
                old, old_key = (batch.column(batch.schema.get_field_index(n)) for n in ("distance", "nearest"))
                smaller = pc.or_(pc.less(told, old), pc.and_(pc.equal(told, old), pc.less(keys, old_key)))
                closer = pc.fill_null(smaller, False)
                told, keys = pc.if_else(closer, told, old), pc.if_else(closer, keys, old_key)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, keys, told], names=[*names, "nearest", "distance"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("nearest", "distance")]
    return rows.mapInArrow(run, ", ".join([*fields, f"nearest {kind}", "distance double"]))


def nearest_centre(
    rows: DataFrame, centres: DataFrame, features: str = "features", centre: str = "centre", vector: str = "vector", limit: int | None = None
) -> DataFrame:
    """``rows`` plus ``nearest``, the key of the closest centre, and ``distance``, their squared distance.

    Centres that fit a broadcast of ``limit`` bytes meet the rows in one pass without a shuffle; more are worked off in
    tiles, one pass each, with the rows and their nearest so far written in between.  Of centres at the same distance the
    one with the smallest key is taken.  Rows with a null vector or components that are null or not finite get null;
    centres like that are left out.  Without centres all rows get null.
    """
    limit = joins.BROADCAST_BYTES if limit is None else limit
    kind = centres.schema[centre].dataType.simpleString()
    told = centres.select(F.col(centre).alias("centre"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    listed, n = numbered(told.where(sound), "_number")
    widest = listed.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, limit // (8 * widest + 64))
    found = rows
    for a in range(0, n, size):
        tile = listed.where((F.col("_number") >= a) & (F.col("_number") < a + size)).select("centre", "vector").toArrow()
        following = with_nearest(found, Centres.of(tile), features, kind)
        if a + size < n:
            following = seal(following, "nearest")
        if found is not rows:
            # Read by the next pass only, which has been written unless it is the last.
            if a + size < n:
                release(found)
        found = following
    release(listed)
    if not n:
        found = rows.withColumns({"nearest": F.lit(None).cast(kind), "distance": F.lit(None).cast("double")})
    return found
