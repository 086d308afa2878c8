"""Merkle manifest of a dataset as postorder append logs.

The rows of a partition value (a *tree*) are leaves in ascending order; every 8 consecutive nodes have one parent, the
last run may be shorter, and the roots of all trees are the leaves of a last tree.  Builders work on aligned blocks of
8**4 nodes, each in one Arrow task: they append a node to the block's log as soon as its children are there, so a log is
the postorder of the block.  The roots of the blocks are the nodes of the next round; a round has 1/4096 of the nodes of
the one before.

Where a node lies in its log follows from subtree sizes alone (:func:`position`), so a proof is read out of a log by
addresses: nothing is searched, and no row is joined to its siblings.  Paths go down from the last tree, one row per
block, and each block turns its own into the proofs of its nodes.

Defined results: null fields are written ``-``; rows with a null doc_id come first in their tree and are proved like any
other; equal rows are leaves of their own with equal leaf hashes; a null partition value is a tree of its own, the first;
an empty table has no rows (and no root); other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.words import lowered
from featherloom.session import release, seal

#: Children of a node, and levels of a block.
FAN, LEVELS = 8, 4

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATHS_SQL = "tree string, block long, slots array<int>, siblings array<string>, subroot string, top string, level long"
PATHS = pa.schema(
    [
        ("tree", pa.string()),
        ("block", pa.int64()),
        ("slots", pa.list_(pa.int32())),
        ("siblings", pa.list_(pa.string())),
        ("subroot", pa.string()),
        ("top", pa.string()),
        ("level", pa.int64()),
    ]
)


def leaf_hash(**changed: Column) -> Column:
    """Digest of a row's fields, each as ``-`` or as byte count, colon and value; ``changed`` replaces fields."""

    def told(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, FIELDS)).cast("binary"), 256))


def tampered() -> Column:
    """Leaf after tampering: where 3 divides the crc32 of the doc_id the text's A-Z are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf_hash(text=lowered(F.col("text")))).otherwise(F.col("leaf"))


# Trees inside a block.


def height_of(total: int, levels: int = LEVELS) -> int:
    """Levels above the nodes of a block: all of them where the tree goes on, else up to the only node."""
    if total > FAN**levels:
        return levels
    height = 0
    while total > 1:
        total, height = -(-total // FAN), height + 1
    return height


def position(level: int, node: int, n: int) -> int:
    """Place of a node in the postorder log of a tree over ``n`` leaves (levels counted from the leaves).

    Before its last leaf e lie e leaves and, per level m, the e // 8**m subtrees of that level that are whole by then;
    after e come its ancestors, level by level.
    """
    last = min((node + 1) * FAN**level, n) - 1
    whole, left = 0, last // FAN
    while left:
        whole, left = whole + left, left // FAN
    return last + whole + level


def digest(hexes: str) -> str:
    return sha256(hexes.encode()).hexdigest()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """Nodes in the order in which they are complete."""
    log: list[bytes] = []
    n = len(leaves)
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        for level in range(1, height + 1):
            if (i + 1) % FAN**level and i + 1 < n:
                break
            children = range(i // FAN**level * FAN, i // FAN ** (level - 1) + 1)
            own = [log[position(level - 1, c, n)] for c in children]
            log.append(sha256(b"".join(own).hex().encode()).digest())
    return log


Path = tuple[list[int], list[str]]


def paths(log: bytes, n: int, height: int, above: Path) -> list[Path]:
    """(slots, siblings) of each leaf, level by level up to the root; ``above`` is the block's own path."""
    upper: list[Path] = [above]
    for level in range(height - 1, -1, -1):
        count = -(-n // FAN**level)
        here: list[Path] = []
        for first in range(0, count, FAN):
            run = range(first, min(first + FAN, count))
            told = [log[32 * p : 32 * p + 32].hex() for p in (position(level, c, n) for c in run)]
            slots, siblings = upper[first // FAN]
            here += [([k, *slots], ["".join(told[:k] + told[k + 1 :]), *siblings]) for k in range(len(told))]
        upper = here
    return upper


def fold(leaf: str, path: Path) -> str:
    """Root recomputed from a leaf and its siblings."""
    for slot, siblings in zip(*path):
        leaf = digest(siblings[: 64 * slot] + leaf + siblings[64 * slot :])
    return leaf


# Rounds.


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``i``, their place in their tree by ``order``, and ``total``, the tree's rows.

    Rows are range-partitioned and sorted, so a place is the place inside a range plus the rows of earlier ranges; those
    are counts per (tree, range).  The last sort key is a row number of the table as written: no run of equal rows is too
    large for a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = ("tree", *order, "_row")
    ranged = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
    placed = seal(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-placed")
    marked = placed.withColumn("_range", F.shiftrightunsigned("_at", 33))
    runs = marked.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "tree", "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"), F.sum("_n").over(tree).alias("total")
    )
    found = marked.join(offsets, ["tree", "_range"]).withColumn("i", F.col("_at") - F.col("_first") + F.col("_earlier"))
    found._sealed_at = placed._sealed_at
    return found.drop("_at", "_range", "_first", "_earlier")


def build_blocks(nodes: DataFrame, carried: dict[str, str], label: str, levels: int) -> DataFrame:
    """One row per block: (tree, block, total, log, root, and a list of each carried column), written out."""
    names = list(carried)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("i").to_numpy(), kind="stable")))
        total = rows.column("total")[0].as_py()
        log = append_log(rows.column("hash").to_pylist(), height_of(total, levels))
        row = {
            "tree": [rows.column("tree")[0].as_py()],
            "block": [rows.column("block")[0].as_py()],
            "total": [total],
            "log": [b"".join(log)],
            "root": [log[-1]],
            **{c: [rows.column(c).to_pylist()] for c in names},
        }
        return pa.table([pa.array(row[f.name], f.type) for f in shape], schema=shape)

    lists = {"long": pa.list_(pa.int64()), "string": pa.list_(pa.string()), "binary": pa.list_(pa.binary())}
    shape = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("log", pa.binary()), ("root", pa.binary())]
        + [(c, lists[kind]) for c, kind in carried.items()]
    )
    schema = "tree string, block long, total long, log binary, root binary" + "".join(f", {c} array<{k}>" for c, k in carried.items())
    placed = nodes.withColumn("block", F.floor(F.col("i") / FAN**levels)).select("tree", "block", "i", "total", "hash", *names)
    return seal(placed.groupBy("tree", "block").applyInArrow(build, schema), label)


def build_rounds(nodes: DataFrame, carried: dict[str, str], label: str, levels: int) -> list[DataFrame]:
    """Blocks of every round, from the leaves up, until each tree is a single block."""
    size = FAN**levels
    rounds = [build_blocks(nodes, carried, label, levels)]
    largest = rounds[0].agg(F.max("total")).first()[0] or 0
    while largest > size:
        largest = -(-largest // size)
        following = rounds[-1].where(F.col("total") > size).select(
            "tree", F.col("block").alias("i"), F.ceil(F.col("total") / size).alias("total"), F.col("root").alias("hash")
        )
        rounds.append(build_blocks(following, {}, label, levels))
    return rounds


@dataclass
class Manifest:
    """Logs of all trees by round, and of the last tree over their roots.

    Leaves of a round-0 block carry their doc_ids and claimed leaves, leaves of the last tree the names of the trees.
    """

    rounds: list[DataFrame]
    last: list[DataFrame]
    levels: int

    def release(self) -> None:
        """Delete the logs."""
        for table in (*self.rounds, *self.last):
            release(table)


def build(docs: DataFrame, claim: Column | None = None, levels: int = LEVELS) -> Manifest:
    """Logs over the rows of ``docs``, a tree per ``lang``.

    ``claim`` is the leaf that each row is checked with later on (from the fields and ``leaf``); by default its own.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    hashed = docs.select(*FIELDS).withColumn("leaf", leaf_hash())
    claimed = F.col("leaf") if claim is None else claim
    leaves = seal(hashed.select(tree.alias("tree"), F.col("doc_id").cast("bigint"), F.col("leaf").alias("hash"), claimed.alias("claim")), "merkle-leaves")
    nodes = ranked(leaves, "doc_id", "hash")
    rounds = build_rounds(nodes, {"doc_id": "long", "claim": "binary"}, "merkle-log", levels)
    release(nodes)
    release(leaves)
    names = None
    for level, blocks in enumerate(rounds):
        done = blocks.where(F.col("total") <= FAN**levels).select(
            F.lit("").alias("tree"), F.col("tree").alias("name"), F.lit(level).cast("bigint").alias("ended"), F.col("root").alias("hash")
        )
        names = done if names is None else names.unionByName(done)
    subroots = seal(names, "merkle-subroots")
    top = ranked(subroots, "name")
    last = build_rounds(top, {"name": "string", "ended": "long"}, "merkle-last", levels)
    release(top)
    release(subroots)
    return Manifest(rounds, last, levels)


def own_leaves(row: dict, levels: int) -> list[str]:
    """Hashes of a block's leaves, read from its log."""
    n = leaves_in(row, levels)
    return [row["log"][32 * p : 32 * p + 32].hex() for p in (position(0, c, n) for c in range(n))]


def leaves_in(row: dict, levels: int) -> int:
    return min(FAN**levels, row["total"] - row["block"] * FAN**levels)


def paths_in(row: dict, levels: int) -> list[Path]:
    return paths(row["log"], leaves_in(row, levels), height_of(row["total"], levels), (row["slots"], row["siblings"]))


def spread_paths(blocks: DataFrame, above: DataFrame, levels: int, named: bool = False) -> DataFrame:
    """Paths of the nodes of ``blocks`` from the blocks' own: (tree, block, slots, siblings, subroot, top, level).

    ``block`` is the node's number, the block it is the root of.  ``named`` nodes are the roots of trees: they take over
    their tree's name, and ``level``, the round that ended it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            found, n = paths_in(row, levels), leaves_in(row, levels)
            told = {
                "tree": row["name"] if named else [row["tree"]] * n,
                "block": [0] * n if named else [row["block"] * FAN**levels + c for c in range(n)],
                "slots": [slots for slots, _ in found],
                "siblings": [siblings for _, siblings in found],
                "subroot": own_leaves(row, levels) if named else [row["subroot"]] * n,
                "top": [row["top"]] * n,
                "level": row["ended"] if named else [None] * n,
            }
            yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) for f in PATHS], schema=PATHS)

    return blocks.join(above.drop("level"), ["tree", "block"]).mapInArrow(spread, PATHS_SQL)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries, one at a time: a row here is a whole block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def block_paths(manifest: Manifest) -> DataFrame:
    """Paths of all round-0 blocks, from the root of everything down."""
    no_path = {"slots": F.array().cast("array<int>"), "siblings": F.array().cast("array<string>")}
    root = manifest.last[-1].select("tree", "block", F.lower(F.hex("root")).alias("top"))
    down = root.withColumns({**no_path, "subroot": F.lit(None).cast("string"), "level": F.lit(None).cast("bigint")})
    for blocks in reversed(manifest.last):
        down = spread_paths(blocks, down, manifest.levels, named=blocks is manifest.last[0])
    tops = seal(down, "merkle-tops")
    found = None
    for level in reversed(range(len(manifest.rounds))):
        ended = tops.where(F.col("level") == level)
        found = ended if found is None else ended.unionByName(spread_paths(manifest.rounds[level + 1], found, manifest.levels))
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    The proof is the siblings on the way from leaf to root; ``folded_root`` is recomputed from the claimed leaf and them.
    """

    levels = manifest.levels

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            found, n = paths_in(row, levels), leaves_in(row, levels)
            folded = [fold(claim.hex(), path) for claim, path in zip(row["claim"], found)]
            told = [
                pa.array(row["doc_id"], pa.int64()),
                pa.array(own_leaves(row, levels)),
                pa.array([row["subroot"]] * n),
                pa.array([row["top"]] * n),
                pa.array([digest("".join(siblings)) for _, siblings in found]),
                pa.array(folded),
                pa.array([f == row["top"] for f in folded]),
            ]
            yield pa.RecordBatch.from_arrays(told, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return manifest.rounds[0].drop("root").join(block_paths(manifest).drop("level"), ["tree", "block"]).mapInArrow(prove, PROOFS)
