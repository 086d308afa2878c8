"""Local descent with weighted averaging: one Spark job per round.

Rows are dealt to replicas.  In a round every replica starts from the common weights, walks through its own rows in
order, updating a private copy after each (or after each small batch), and hands in its weights times the rows they
learned from.  Sums per weight, divided by the rows, are the next common weights.  One replica is the serial descent;
the number of jobs does not depend on the number of updates.

A replica's rows are streamed through its task in order, so it may have any number of them.  In memory are the private
weights: a whole network, or of a sparse autoencoder the columns that the replica's documents hold.  Autoencoder
replicas that are read together take their steps together, and a task hands on the sums of all its replicas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.operators import joins
from featherloom.operators.joins import HotKeys, count_keys, fits_broadcast
from featherloom.plans import blocks, feedforward, sparse_ae
from featherloom.plans.feedforward import Weights
from featherloom.plans.settings import NetworkSettings, SparseAutoencoderSettings
from featherloom.session import check_state_size, part_of, release, seal, sealed

#: Cells of documents, at least, whose columns are looked up together.
LOOKUP_CELLS = 1 << 20

#: Bytes of private weights that are updated or handed on together.
BLOCK_BYTES = 16 * 1024 * 1024


def dealt(key: str, replicas: int, seed: int) -> Column:
    """Replica of a row by a hash of its key."""
    if replicas < 1:
        raise ValueError("at least one replica is needed")
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(replicas))


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    bounds = [0, *cuts.tolist(), len(values)]
    return zip(bounds[:-1], bounds[1:])


# Sparse autoencoder.


def document_rows(words: DataFrame, replica: Column, order: Column, known: pa.Array | None = None) -> DataFrame:
    """(replica, kind, place, doc, ids, cols, vals, w): whole documents; a document holds a column once.

    Columns in ``known`` are told by their places there (``ids``), others by name (``cols``); ``vals`` has the values of
    the former, then of the latter.
    """
    found = _fragments(words, known).groupBy("doc").agg(F.collect_list(F.struct("ids", "cols", "id_vals", "col_vals")).alias("parts"))

    def merged(keys: str, values: str) -> Column:
        """Pairs of a document that came in several parts, sorted as the pairs of one part are."""
        pairs = F.transform("parts", lambda p: F.zip_with(p[keys], p[values], lambda k, v: F.struct(k.alias("k"), v.alias("v"))))
        return F.sort_array(F.flatten(pairs))

    def either(keys: str, values: str, field: str) -> Column:
        whole = F.col("parts")[0][keys if field == "k" else values]
        return F.when(F.size("parts") > 1, F.transform(merged(keys, values), lambda x: x[field])).otherwise(whole)

    return found.select(
        replica.cast("bigint").alias("replica"),
        F.lit(1).alias("kind"),
        order.cast("bigint").alias("place"),
        "doc",
        either("ids", "id_vals", "k").alias("ids"),
        either("cols", "col_vals", "k").alias("cols"),
        F.concat(either("ids", "id_vals", "v"), either("cols", "col_vals", "v")).alias("vals"),
        F.array().cast("array<double>").alias("w"),
    )


def _fragments(words: DataFrame, known: pa.Array | None) -> DataFrame:
    """(doc, ids, cols, id_vals, col_vals): cells of a document that lie near each other, sorted; one row or more a document."""
    bound = words.sparkSession.sparkContext.broadcast(known)
    doc, col = (words.schema[c].dataType.simpleString() for c in ("doc", "col"))

    def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    def fragments(rows: pa.RecordBatch) -> pa.RecordBatch:
        docs, cols = (rows.column(k).dictionary_encode(null_encoding="encode") for k in (0, 1))
        names, n = cols.dictionary, len(docs.dictionary)
        place = np.full(len(names), -1)
        if bound.value is not None:
            found = pc.index_in(names, value_set=bound.value.cast(names.type), skip_nulls=True)
            place = found.fill_null(-1).to_numpy().astype(np.int64)
        # Places of known columns, then the rank of the name.
        other, top = np.flatnonzero(place < 0), int(place.max(initial=-1)) + 1
        place[other[pc.sort_indices(names.take(pa.array(other))).to_numpy()]] = top + np.arange(len(other))
        own = docs.indices.to_numpy().astype(np.int64)
        code = place[cols.indices.to_numpy()]
        at = np.argsort(own * (top + len(other)) + code)
        held = code[at] < top
        near, far = at[held], at[~held]
        values = rows.column(2).to_numpy()
        counts = [np.bincount(own[part], minlength=n) for part in (near, far)]
        told = [
            docs.dictionary,
            lists(pa.array(code[near], pa.int32()), counts[0]),
            lists(rows.column(1).take(pa.array(far)), counts[1]),
            lists(pa.array(values[near]), counts[0]),
            lists(pa.array(values[far]), counts[1]),
        ]
        return pa.RecordBatch.from_arrays(told, names=["doc", "ids", "cols", "id_vals", "col_vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, lambda batch: batch.num_rows):
            yield fragments(rows)

    cells = words.select("doc", "col", F.col("value").cast("double"))
    return cells.mapInArrow(run, f"doc {doc}, ids array<int>, cols array<{col}>, id_vals array<double>, col_vals array<double>")


def _gathered(batches: Iterator[pa.RecordBatch], cells: Callable[[pa.RecordBatch], int]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``LOOKUP_CELLS`` cells."""
    waiting, held = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        held += cells(batch)
        if held >= LOOKUP_CELLS:
            yield _together(waiting)
            waiting, held = [], 0
    if waiting:
        yield _together(waiting)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def weight_rows(touched: DataFrame, table: DataFrame) -> DataFrame:
    """Weights of every replica's own columns in the layout of :func:`document_rows`, to come before its documents."""
    return touched.join(table, "col").select(
        "replica",
        F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("place"),
        F.lit(None).cast(touched.schema["doc"].dataType).alias("doc"),
        F.array().cast("array<int>").alias("ids"),
        F.array("col").alias("cols"),
        F.array().cast("array<double>").alias("vals"),
        F.concat("w_in", "w_out", F.array("b_out")).alias("w"),
    )


@dataclass(frozen=True)
class Common:
    """Weights that every replica starts from: one row (w_in, w_out, b_out) of ``w`` for each of ``cols``, and the hidden bias."""

    cols: pa.Array
    w: np.ndarray
    bias: np.ndarray


@dataclass
class Open:
    """A replica whose documents may go on: its private weights and how many of its documents have changed each column."""

    number: int
    codes: np.ndarray
    w: np.ndarray
    met: np.ndarray
    bias: np.ndarray
    docs: int
    loss: float


class Walk:
    """The replicas of one task, each with private weights of the columns that its documents hold.

    Replicas don't depend on each other, so those that are read together take their steps together: all first documents,
    then all second ones.  What they have learned is added up in the task; only the replica read last stays open.

    A column's code is its place in ``common``, or else follows these by its place in ``names``.
    """

    def __init__(self, common: Common, settings: SparseAutoencoderSettings) -> None:
        self.common, self.settings = common, settings
        self.known, self.width = len(common.cols), settings.hidden
        self.at_once = max(1, BLOCK_BYTES // (8 * (2 * self.width + 1)))
        self.names = common.cols.slice(0, 0)
        self.open: Open | None = None
        self.sums, self.n = np.zeros((self.known, 2 * self.width + 1)), np.zeros(self.known)
        self.bias, self.loss, self.docs = np.zeros(self.width), 0.0, 0

    def read(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows in the order of :func:`descend`, worked off in blocks; what is learned of columns not in ``common``."""
        replica, kind = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        ids, cols = (pc.list_value_length(rows.column(k)).to_numpy() for k in (4, 5))
        sizes = ids + cols
        codes = np.empty(sizes.sum(), np.int64)
        is_id = np.arange(len(codes)) < np.repeat(np.cumsum(sizes) - cols, sizes)
        codes[is_id] = rows.column(4).flatten().to_numpy()
        codes[~is_id] = self._coded(rows.column(5).flatten())
        value = rows.column(6).flatten().to_numpy()
        given = rows.column(7).flatten().to_numpy().reshape(-1, 2 * self.width + 1)
        # Cells, values and given weights before each row.
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values = np.concatenate([[0], np.cumsum(np.where(kind == 1, sizes, 0))])
        weights = np.concatenate([[0], np.cumsum(kind == 0)])
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + self.at_once, "right")) - 1)
            yield from self._block(
                replica[a:b], kind[a:b], sizes[a:b], codes[ends[a] : ends[b]], value[values[a] : values[b]], given[weights[a] : weights[b]]
            )
            a = b

    def _coded(self, cols: pa.Array) -> np.ndarray:
        """Codes of columns outside ``common``; the open replica's codes are brought up to the new names."""
        other = np.empty(0, np.int64) if self.open is None else np.flatnonzero(self.open.codes >= self.known)
        if len(other):
            cols = pa.concat_arrays([self.names.take(pa.array(self.open.codes[other] - self.known)), cols])
        found = cols.dictionary_encode()
        self.names = found.dictionary
        codes = self.known + found.indices.to_numpy().astype(np.int64)
        if len(other):
            self.open.codes[other] = codes[: len(other)]
        return codes[len(other) :]

    def _block(
        self, replica: np.ndarray, kind: np.ndarray, sizes: np.ndarray, codes: np.ndarray, value: np.ndarray, given: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """Rows of one or more replicas: weights given to them (kind 0) and documents (kind 1)."""
        if self.open is not None and self.open.number != replica[0]:
            yield from self._close()
        number = np.concatenate([[0], np.cumsum(np.diff(replica) != 0)])
        last = int(number[-1])
        span = self.known + len(self.names)
        before = np.empty(0, np.int64) if self.open is None else self.open.codes
        slots, at = np.unique(np.concatenate([before, np.repeat(number, sizes) * span + codes]), return_inverse=True)
        owner, code = slots // span, slots % span
        at, carried = at[len(before) :], at[: len(before)]
        is_given = np.repeat(kind == 0, sizes)

        w, met = np.empty((len(slots), 2 * self.width + 1)), np.zeros(len(slots), np.int64)
        has = code < self.known
        w[has] = self.common.w[code[has]]
        bias, docs, loss = np.tile(self.common.bias, (last + 1, 1)), np.zeros(last + 1, np.int64), np.zeros(last + 1)
        if self.open is not None:
            w[carried], met[carried], has[carried] = self.open.w, self.open.met, True
            bias[0], docs[0], loss[0] = self.open.bias, self.open.docs, self.open.loss
        w[at[is_given]], has[at[is_given]] = given, True
        if not has.all():
            raise ValueError("a document holds a column without weights")

        mine, lengths, at = number[kind == 1], sizes[kind == 1], at[~is_given]
        step = np.arange(len(mine)) - np.searchsorted(mine, mine)
        order = np.argsort(step, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        mine, lengths = mine[order], lengths[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cells = np.arange(ends[-1]) + np.repeat(begins - ends[:-1], lengths)
        at, value = at[cells], value[cells]
        a = 0
        for b in np.cumsum(np.bincount(step)).tolist():
            part = slice(ends[a], ends[b])
            self._learn(w, bias, loss, at[part], value[part], mine[a:b], lengths[a:b])
            met[at[part]] += 1
            docs[mine[a:b]] += 1
            a = b

        done = owner < last
        yield from self._add(code[done], w[done], met[done])
        self._add_bias(bias[:last], docs[:last], loss[:last])
        self.open = Open(int(replica[-1]), code[~done], w[~done], met[~done], bias[last], int(docs[last]), float(loss[last]))

    def _learn(
        self, w: np.ndarray, bias: np.ndarray, loss: np.ndarray, at: np.ndarray, value: np.ndarray, mine: np.ndarray, lengths: np.ndarray
    ) -> None:
        """One update of each replica in ``mine`` from one document, on its own columns."""
        s, k = self.settings, self.width
        starts = np.cumsum(lengths) - lengths
        own = w[at]
        w_in, w_out, b_out = own[:, :k], own[:, k:-1], own[:, -1]
        hidden = blocks.sigmoid(np.add.reduceat(value[:, None] * w_in, starts) + bias[mine])
        met_hidden = np.repeat(hidden, lengths, axis=0)
        out = blocks.sigmoid(np.einsum("ij,ij->i", w_out, met_hidden) + b_out)
        error = (out - value) * out * (1.0 - out)
        back = np.add.reduceat(error[:, None] * w_out, starts) * hidden * (1.0 - hidden)
        rate = s.learning_rate
        step = np.empty_like(own)
        step[:, :k] = value[:, None] * np.repeat(back, lengths, axis=0) + 2.0 * s.decay_in * w_in
        step[:, k:-1] = error[:, None] * met_hidden + 2.0 * s.decay_out * w_out
        step[:, -1] = error + s.decay_bias * b_out
        w[at] = own - rate * step
        loss[mine] += np.add.reduceat((out - value) ** 2, starts) / lengths
        bias[mine] -= rate * (back + 2.0 * s.decay_bias * bias[mine])

    def _add(self, codes: np.ndarray, w: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Changed weights of finished replicas, added up by column; those not in ``common`` are handed on."""
        moved = np.flatnonzero(met)
        if not len(moved):
            return
        moved = moved[np.argsort(codes[moved], kind="stable")]
        found = codes[moved]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(found) != 0]))
        n = np.add.reduceat(met[moved], starts).astype(np.float64)
        sums = np.add.reduceat(w[moved] * met[moved, None], starts)
        found = found[starts]
        known = int(np.searchsorted(found, self.known))
        self.sums[found[:known]] += sums[:known]
        self.n[found[:known]] += n[:known]
        yield from self._told(self.names, found[known:] - self.known, sums[known:], n[known:])

    def _add_bias(self, bias: np.ndarray, docs: np.ndarray, loss: np.ndarray) -> None:
        self.bias += docs @ bias
        self.docs += int(docs.sum())
        self.loss += float(loss.sum())

    def _close(self) -> Iterator[pa.RecordBatch]:
        own, self.open = self.open, None
        yield from self._add(own.codes, own.w, own.met)
        self._add_bias(own.bias[None, :], np.array([own.docs]), np.array([own.loss]))

    def _told(self, cols: pa.Array, places: np.ndarray, sums: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(col, w_in, w_out, b_out, n) with mean weights."""
        for a in range(0, len(places), self.at_once):
            b = a + self.at_once
            mean = sums[a:b] / n[a:b, None]
            yield self._batch(cols.take(pa.array(places[a:b])), mean, n[a:b])

    def _batch(self, cols: pa.Array, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = self.width
        told = [cols, blocks.array_column(w[:, :k]), blocks.array_column(w[:, k:-1]), pa.array(w[:, -1]), pa.array(n)]
        return pa.RecordBatch.from_arrays(told, names=["col", "w_in", "w_out", "b_out", "n"])

    def learned(self) -> Iterator[pa.RecordBatch]:
        """What is left to tell; the row without a column holds hidden bias and loss."""
        if self.open is not None:
            yield from self._close()
        places = np.flatnonzero(self.n)
        yield from self._told(self.common.cols, places, self.sums[places], self.n[places])
        if self.docs:
            w = np.concatenate([self.bias, np.zeros(self.width), [self.loss]])[None, :] / self.docs
            yield self._batch(pa.nulls(1, self.common.cols.type), w, np.array([float(self.docs)]))


def descend(stream: DataFrame, start: Common, settings: SparseAutoencoderSettings) -> DataFrame:
    """(col, w_in, w_out, b_out, n) that replicas have learned from their documents; a task's replicas are averaged.

    Documents tell columns of ``start`` by their places in it.  Weights of others come in the stream, to each replica its
    own and before its documents.
    """
    bound = stream.sparkSession.sparkContext.broadcast(start)
    kind = stream.schema["cols"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(bound.value, settings)
        for rows in _gathered(batches, lambda batch: sum(len(batch.column(k).flatten()) for k in (4, 5))):
            yield from walk.read(rows)
        yield from walk.learned()

    found = stream.repartition("replica").sortWithinPartitions("replica", "kind", "place", "doc")
    return found.mapInArrow(run, f"col {kind}, w_in array<double>, w_out array<double>, b_out double, n double")


def averaged(learned: DataFrame, width: int) -> DataFrame:
    """(col, w_in, w_out, b_out): weights of all replicas, each counting the documents that have changed it."""
    sums = sparse_ae.summed_arrays(
        learned, ["col"], {"w_in": ("w_in", "n"), "w_out": ("w_out", "n")}, width, F.sum(F.col("b_out") * F.col("n")).alias("b_out"), F.sum("n").alias("n")
    )
    whole = {name: F.transform(name, lambda x: x / F.col("n")) for name in ("w_in", "w_out")}
    return sums.withColumns({**whole, "b_out": F.col("b_out") / F.col("n")}).drop("n")


def _collected(table: DataFrame, bias: np.ndarray, cols: pa.Array | None = None) -> Common:
    """A weight table small enough to broadcast, as arrays in the order of ``cols``."""
    found = table.select("col", F.concat("w_in", "w_out", F.array("b_out")).alias("w")).toArrow().combine_chunks()
    if not found.num_rows:
        return Common(pa.array([], found.schema.field("col").type), np.empty((0, 2 * len(bias) + 1)), bias)
    rows = found.to_batches()[0]
    w = blocks.matrix(rows, "w")
    if cols is None:
        return Common(rows.column(0), w, bias)
    at = pc.index_in(cols, value_set=rows.column(0))
    if at.null_count:
        raise ValueError("a document holds a column without weights")
    return Common(cols, w[at.to_numpy()], bias)


def _names(table: DataFrame) -> pa.Array:
    """The columns of a small table, sorted."""
    found = table.select("col").toArrow().column("col").combine_chunks()
    return found.take(pc.sort_indices(found))


def _frequent(words: DataFrame, width: int) -> DataFrame:
    """(col) of the most frequent columns, whose weights fit a broadcast."""
    counts = seal(count_keys(words, "col"), "columns")
    spread = sparse_ae.Spread(words, HotKeys("col"), HotKeys("doc"), counts)
    near = seal(spread.frequent(joins.BROADCAST_BYTES // (8 * (2 * width + 1) + 64)), "frequent")
    release(counts)
    return near


def _touched(rows: DataFrame) -> DataFrame:
    """(replica, col, doc) of the columns that documents tell by name."""
    cells = rows.select("replica", "doc", F.explode("cols").alias("col"))
    return seal(cells.groupBy("replica", "col").agg(F.min("doc").alias("doc")), "touched")


def train_sparse(
    words: DataFrame,
    settings: SparseAutoencoderSettings,
    replicas: int = 8,
    replica: Column | None = None,
    order: Column | None = None,
    table: DataFrame | None = None,
    hidden_bias: np.ndarray | None = None,
) -> sparse_ae.SparseAutoencoderModel:
    """``settings.iterations`` rounds over (doc, col, value), one row per cell.

    ``replica`` and ``order`` (expressions of ``doc``) deal the documents and say in which order a replica meets them;
    by default both are hashes.  A weight is the mean over the replicas that changed it, counted by the documents they
    did it with; ``losses`` holds the mean document loss of each round, met before the updates.

    Weights that fit a broadcast go to the tasks that way, and the documents move once a round.  Of wider ones the most
    frequent columns' do; others travel with the documents: each replica is sent those it needs.
    """
    dealing = dealt("doc", replicas, settings.seed) if replica is None else replica
    places = F.xxhash64("doc", F.lit(settings.seed + 1)) if order is None else order
    base = sealed(words, "triples")
    given = table is not None
    current = seal(sparse_ae.initial_weight_table(base, settings), "weights") if not given else table
    bias = sparse_ae.initial_hidden_bias(settings) if hidden_bias is None else hidden_bias
    width = settings.hidden
    whole = fits_broadcast(current, 2 * width + 1)
    near = None if whole else _frequent(base, width)
    cols = _names(current if whole else near)
    rows = seal(document_rows(base, dealing, places, cols), "documents")
    if base is not words:
        release(base)
    touched = None if whole else _touched(rows)
    model = sparse_ae.SparseAutoencoderModel(settings, current, bias)
    for turn in range(settings.iterations):
        if whole:
            learned = descend(rows, _collected(current, bias, cols), settings)
        else:
            shared = _collected(current.join(F.broadcast(near), "col", "left_semi"), bias, cols)
            learned = descend(rows.unionByName(weight_rows(touched, current)), shared, settings)
        means = averaged(learned, width)
        old = current.select("col", *[F.col(c).alias(f"_{c}") for c in ("w_in", "w_out", "b_out")])
        kept = [F.coalesce(c, f"_{c}").alias(c) for c in ("w_in", "w_out", "b_out")]
        both = seal(means.join(old, "col", "full").select("col", *kept), "weights")
        common = both.where(F.col("col").isNull()).first()
        if turn or not given:
            release(current)
        current = part_of(both, F.col("col").isNotNull())
        if common is not None:
            bias = np.array(common["w_in"])
            model.losses.append(common["b_out"])
    release(rows)
    for part in (near, touched):
        if part is not None:
            release(part)
    model.table, model.hidden_bias = current, bias
    return model


# Dense networks.


@dataclass
class _Replica:
    """A network of its own with the rows that wait for the next update."""

    weights: Weights
    velocity: Weights
    active: list[np.ndarray]
    rows: int = 0
    updates: int = 0
    loss: float = 0.0


def train_network(
    rows: DataFrame,
    settings: NetworkSettings,
    batch_size: int,
    rounds: int,
    replicas: int = 8,
    replica: Column | None = None,
    order: Column | None = None,
    init_weights: Weights | None = None,
) -> feedforward.TrainedNetwork:
    """``rounds`` rounds over (id, label, features): an update after every ``batch_size`` rows of a replica.

    The last batch of a replica may be smaller, so every row is learned from once a round.  Momentum starts anew each
    round.  ``train_losses`` holds the half mean squared error of each round, met before the updates.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    weights = feedforward.initial_weights(settings) if init_weights is None else init_weights
    check_state_size(sum(w.size for w in weights), "the network")
    dealing = dealt("id", replicas, settings.seed) if replica is None else replica
    places = F.xxhash64("id", F.lit(settings.seed + 1)) if order is None else order
    staged = seal(
        rows.select(dealing.cast("bigint").alias("replica"), places.cast("bigint").alias("place"), "id", "label", "features"), "rows"
    )
    ordered = staged.repartition("replica").sortWithinPartitions("replica", "place", "id")
    model = feedforward.TrainedNetwork(settings, weights)
    rate = settings.learning_rate
    for turn in range(rounds):
        found = blocks.collect_sums(blocks.added_up(network_round(ordered, weights, settings, batch_size, rate, turn)))
        if "n" not in found:
            break
        n, squared = found["n"][0]
        weights = [found[f"w{k}"] / n for k in range(len(weights))]
        model.train_losses.append(float(0.5 * squared / n))
        rate *= settings.rate_scaling
    release(staged)
    model.weights = weights
    return model


def network_round(
    ordered: DataFrame, weights: Weights, settings: NetworkSettings, batch_size: int, rate: float, turn: int
) -> DataFrame:
    """Per task: sums over its replicas of weights times rows (``w0``, ``w1``, ...), and of rows and squared errors (``n``)."""
    bound = ordered.sparkSession.sparkContext.broadcast([w.astype(settings.dtype) for w in weights])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        state: _Replica | None = None
        number, waiting, held = None, [], 0

        def update() -> None:
            nonlocal waiting, held
            ids, x, y = (np.concatenate(part) for part in zip(*waiting))
            waiting, held = [], 0
            learn(state, ids, x, y, settings, rate, turn)

        def finish() -> None:
            if held:
                update()
            if state is not None and state.rows:
                told = {f"w{k}": w.astype(np.float64) * state.rows for k, w in enumerate(state.weights)}
                told["n"] = np.array([[state.rows, state.loss]], float)
                for name, value in told.items():
                    acc[name] = acc[name] + value if name in acc else value

        for batch in batches:
            if batch.num_rows == 0:
                continue
            numbers = batch.column(0).to_numpy()
            ids = blocks.vector(batch, "id")
            x, y = blocks.matrix(batch, "features", settings.dtype), blocks.matrix(batch, "label", settings.dtype)
            for a, b in runs(numbers):
                if numbers[a] != number:
                    finish()
                    number = numbers[a]
                    start = bound.value
                    state = _Replica(start, feedforward.zero_like(start), [np.zeros(n) for n in settings.sizes[1:-1]])
                while a < b:
                    end = min(b, a + batch_size - held)
                    waiting.append((ids[a:end], x[a:end], y[a:end]))
                    held, a = held + end - a, end
                    if held == batch_size:
                        update()
        finish()
        yield blocks.sum_rows(acc)

    return ordered.mapInArrow(run, blocks.SUM_SCHEMA)


def learn(
    state: _Replica, ids: np.ndarray, x: np.ndarray, y: np.ndarray, settings: NetworkSettings, rate: float, turn: int
) -> None:
    """One update of a replica from a small batch."""
    seed = turn * 1_000_003 + state.updates + 1
    if settings.input_mask > 0:
        x = x * (blocks.cell_draws(ids, x.shape[1], seed * 1009) >= settings.input_mask)
    found = feedforward.forward_block(x, state.weights, settings, ids, seed)
    error = y - found.output
    active = None
    if settings.sparsity_penalty > 0:
        state.active = active = [
            settings.activation_gain * found.inputs[k + 1][:, 1:].mean(axis=0) + settings.activation_decay * old
            for k, old in enumerate(state.active)
        ]
    gradients = [g / len(x) for g in feedforward.gradient_block(found, error, state.weights, settings, active)]
    state.weights, state.velocity = feedforward.apply_gradients(state.weights, state.velocity, gradients, rate, settings)
    state.updates += 1
    state.rows += len(x)
    state.loss += float((error.astype(np.float64) ** 2).sum())
