"""Equi joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.session import sealed_rows

#: A key can only be hot when it holds more than 1/HOT_PIECES of all rows, so there
#: are fewer than HOT_PIECES hot keys whatever the data: a proven bound for the list.
HOT_PIECES = 4096

#: Keys with fewer rows than this fit one task comfortably and are never split.
HOT_FLOOR = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a join column with the number of salts each is split into.

    ``table`` is (key, salts) with fewer than ``HOT_PIECES`` rows, or None when no
    key is hot; the joins then stay plain.
    """

    key: str
    table: DataFrame | None = None

    def salt(self, rows: DataFrame, spread: list[str], name: str) -> DataFrame:
        """Add each row's salt: a hash of ``spread`` for hot keys, 0 for the others."""
        if self.table is None:
            return rows
        by_hash = F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int")
        return (
            rows.join(F.broadcast(self.table), self.key, "left")
            .withColumn(name, F.when(F.col("salts").isNull(), 0).otherwise(by_hash))
            .drop("salts")
        )

    def repeat(self, per_key: DataFrame, name: str) -> DataFrame:
        """Repeat the row of each hot key once per salt."""
        if self.table is None:
            return per_key
        last = F.coalesce("salts", F.lit(1)) - 1
        return (
            per_key.join(F.broadcast(self.table), self.key, "left")
            .withColumn(name, F.explode(F.sequence(F.lit(0), last)))
            .drop("salts")
        )

    def on(self, name: str) -> list[str]:
        """Join columns of a salted join."""
        return [self.key] if self.table is None else [self.key, name]

    def join(self, rows: DataFrame, per_key: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
        """``rows`` joined to a table with one row per key, hot keys split."""
        salted = self.salt(rows, spread, "_salt")
        return salted.join(self.repeat(per_key, "_salt"), self.on("_salt"), how).drop("_salt")


def find_hot(
    counts: DataFrame, key: str, n: str = "n", pieces: int = HOT_PIECES, floor: int = HOT_FLOOR
) -> HotKeys:
    """Hot keys from a table of row counts per key.

    Salts are proportional to the key's share, so each piece of a hot key ends up
    with about 1/pieces of all rows.
    """
    whole, largest = counts.agg(F.sum(n), F.max(n)).first()
    if not whole or largest <= floor or largest * pieces <= whole:
        return HotKeys(key)
    share = F.col(n).cast("double") * pieces / float(whole)
    hot = counts.where((F.col(n) > floor) & (share > 1.0)).select(key, F.ceil(share).cast("int").alias("salts"))
    listed = counts.sparkSession.createDataFrame(hot.collect(), hot.schema)
    return HotKeys(key, listed)


def count_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_of(rows: DataFrame, key: str, pieces: int = HOT_PIECES, floor: int = HOT_FLOOR) -> HotKeys:
    """Hot keys of ``rows``; a sealed table with no more rows than ``floor`` has none."""
    known = sealed_rows(rows)
    if known is not None and known <= floor:
        return HotKeys(key)
    return find_hot(count_keys(rows, key), key, "n", pieces, floor)


def join_skewed(
    rows: DataFrame, per_key: DataFrame, key: str, spread: list[str], pieces: int = HOT_PIECES, floor: int = HOT_FLOOR
) -> DataFrame:
    """Inner join of ``rows`` to a table with one row per key, hot keys split.

    Rows of a hot key are spread by a hash of ``spread``; the key's row is repeated
    once per salt.  Spark broadcasts ``per_key`` by itself when its measured size
    allows.
    """
    return hot_of(rows, key, pieces, floor).join(rows, per_key, spread)


def keep_keys(rows: DataFrame, keys: DataFrame, key: str, spread: list[str], floor: int = HOT_FLOOR) -> DataFrame:
    """Rows whose key occurs in ``keys`` (semi join), hot keys split."""
    wanted = keys.select(key).distinct()
    return hot_of(rows, key, HOT_PIECES, floor).join(rows, wanted, spread, "left_semi")


#: Largest table that is broadcast by hint.
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame, values_per_row: int, limit: int | None = None) -> bool:
    """True for a sealed table whose counted rows stay below ``limit`` bytes.

    A row is taken as its 8-byte values plus 64 bytes of key and bookkeeping.
    """
    rows = sealed_rows(table)
    return rows is not None and rows * (8 * values_per_row + 64) <= (BROADCAST_BYTES if limit is None else limit)


def label_rows(rows: DataFrame, labels: DataFrame, key: str = "doc") -> DataFrame:
    """Inner join of rows to their labels by explicit id (never by position).

    Both sides hold one row per id, so there is nothing to salt.
    """
    return rows.join(labels, key, "inner")


def shifted_label(label: str | Column, shift: int = -1) -> Column:
    """1/2 labels to 0/1."""
    c = F.col(label) if isinstance(label, str) else label
    return c + F.lit(shift)
