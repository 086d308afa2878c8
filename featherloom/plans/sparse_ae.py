"""Autoencoder on sparse documents, with the weights as a table.

Data are triples (doc, col, value).  Weights are one row per column,
(col, w_in array, w_out array, b_out), so the model may be as wide as the
vocabulary; only the hidden bias, one number per hidden unit, lives on the driver.

A document is reconstructed on its own columns alone.  Every sum is a partial
aggregate, and both joins (on the column, on the document) split hot keys.
Of weights that do not fit a broadcast, those of the most frequent words are broadcast,
and only the cells of other words meet theirs in a shuffle.  Wide hidden layers are
worked off in slices instead (:mod:`sliced_ae`) where one slice can hold all columns.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.functions.activations import sigmoid, sigmoid_all, sigmoid_slope
from featherloom.functions.seeded import hashed, uniform, uniform_array
from featherloom.functions.vectors import dot, scale
from featherloom.operators import joins
from featherloom.operators.joins import HOT_FLOOR, HOT_PIECES, HotKeys, count_keys, find_hot, fits_broadcast, hot_of
from featherloom.plans import sliced_ae
from featherloom.plans.settings import SparseAutoencoderSettings
from featherloom.session import release, seal, sealed, sealed_rows
from featherloom.sources.models import load_table_model, save_table_model

#: Up to this many array slots are summed as separate columns in generated code.
MAX_SUM_COLUMNS = 128

#: From so many hidden units on, weights beyond a broadcast are cut into slices: the cells of rare
#: words would carry long arrays.
SLICED_UNITS = 32


def in_slices(table: DataFrame, width: int) -> bool:
    """Whether a step reads slices: their jobs grow with the units, never with the columns."""
    if width < SLICED_UNITS or fits_broadcast(table, width + 1):
        return False
    rows = sealed_rows(table)
    return rows is None or sliced_ae.tile_shape(rows, width, joins.BROADCAST_BYTES)[0] >= rows


def initial_weight_table(triples: DataFrame, settings: SparseAutoencoderSettings) -> DataFrame:
    """Uniform weights for every column that occurs; each draw is a hash of (column, unit, seed)."""
    low, high, k, seed = settings.weight_low, settings.weight_high, settings.hidden, settings.seed
    return triples.select("col").distinct().select(
        "col",
        uniform_array(hashed(seed), "col", k, low, high).alias("w_in"),
        uniform_array(hashed(seed + 1), "col", k, low, high).alias("w_out"),
        uniform(hashed(seed + 2), "col", F.lit(0), low, high).alias("b_out"),
    )


def initial_hidden_bias(settings: SparseAutoencoderSettings) -> np.ndarray:
    rng = np.random.default_rng(settings.seed)
    return rng.uniform(settings.weight_low, settings.weight_high, settings.hidden)


def replicas(
    columns: DataFrame, settings: SparseAutoencoderSettings, count: int, distinct_seeds: bool = False
) -> DataFrame:
    """``count`` copies of the initial weight table, tagged ``replica``.

    All copies share the seed unless ``distinct_seeds``, which gives an ensemble.
    """
    k, low, high = settings.hidden, settings.weight_low, settings.weight_high
    tagged = columns.select("col").distinct().withColumn(
        "replica", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    )
    shift = F.col("replica") if distinct_seeds else F.lit(0)

    def array(seed: int) -> Column:
        draw = hashed(seed)
        slots = F.sequence(F.lit(0), F.lit(k - 1))
        return F.transform(slots, lambda u: draw(F.col("col"), u + shift * k) * (high - low) + low)

    return tagged.select(
        "replica",
        "col",
        array(settings.seed).alias("w_in"),
        array(settings.seed + 1).alias("w_out"),
        (hashed(settings.seed + 2)(F.col("col"), shift) * (high - low) + low).alias("b_out"),
    )


@dataclass(frozen=True)
class Spread:
    """Triples written once, with the hot keys of both join columns known.

    With weights small enough to broadcast, every branch of a pass starts from the
    same exchange of the thin (doc, col, value) rows on the document, which Spark
    plans once and reuses; sums and joins per document then move nothing more.
    Of larger weights the most frequent words' are broadcast, and the cells of the
    other words, few in any text, are joined on the column first.  Where a key is hot
    its rows carry a salt for the join on that key.
    """

    rows: DataFrame
    hot_cols: HotKeys
    hot_docs: HotKeys
    #: (col, n) of all rows, where they were counted.
    counts: DataFrame | None = None

    @classmethod
    def of(cls, triples: DataFrame, pieces: int = HOT_PIECES, floor: int = HOT_FLOOR) -> Spread:
        base = sealed(triples, "triples")
        hot_cols, hot_docs, counts = HotKeys("col"), hot_of(base, "doc", pieces, floor), None
        if sealed_rows(base) > floor:
            counts = seal(count_keys(base, "col"), "columns")
            hot_cols = find_hot(counts, "col", "n", pieces, floor)
        return cls(hot_docs.salt(hot_cols.salt(base, ["doc"], "_cs"), ["col"], "_ds"), hot_cols, hot_docs, counts)

    def where(self, condition: Column) -> Spread:
        return Spread(self.rows.where(condition), self.hot_cols, self.hot_docs, self.counts)

    def frequent(self, limit: int) -> DataFrame:
        """(col) of the most frequent columns, at most ``limit``; their counts are parted by powers of two."""
        counts = count_keys(self.rows, "col") if self.counts is None else self.counts
        size = F.floor(F.log2("n"))
        least = None
        for row in sorted(counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
            limit -= row["n"]
            if limit < 0:
                break
            least = row["size"]
        return counts.where(F.lit(False) if least is None else size >= least).select("col")

    def parts(
        self, table: DataFrame, values_per_row: int, *columns: str, how: str = "inner", by_doc: bool = True
    ) -> list[DataFrame]:
        """The parts of :meth:`with_weights`: one where the weights fit a broadcast, else frequent and other columns."""
        weights = table.select("col", *columns)
        rows = self.rows.repartition(*self.hot_docs.on("_ds")) if by_doc else self.rows
        if fits_broadcast(table, values_per_row):
            return [rows.join(F.broadcast(weights), "col", how)]
        words = self.frequent(joins.BROADCAST_BYTES // (8 * values_per_row + 64))
        near = weights.join(F.broadcast(words), "col", "left_semi")
        others = self.rows.join(F.broadcast(near.select("col")), "col", "left_anti")
        rest = others.join(self.hot_cols.repeat(weights, "_cs"), self.hot_cols.on("_cs"), how)
        return [rows.join(F.broadcast(near), "col"), rest]

    def with_weights(
        self, table: DataFrame, values_per_row: int, *columns: str, how: str = "inner", by_doc: bool = True
    ) -> DataFrame:
        """Triples joined to the named weight columns of their column.

        ``by_doc`` partitions them by document first, for passes whose branches share that
        exchange; a single sum per document moves less by combining where the rows are.
        """
        by_doc = by_doc and fits_broadcast(table, values_per_row)
        return together(self.parts(table, values_per_row, *columns, how=how, by_doc=by_doc))

    def with_documents(self, rows: DataFrame, per_doc: DataFrame) -> DataFrame:
        """Join to a table with one row per document; its share of a partition is hashed, not sorted."""
        repeated = self.hot_docs.repeat(per_doc, "_ds")
        return rows.join(repeated.hint("shuffle_hash"), self.hot_docs.on("_ds"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summed_arrays(
    rows: DataFrame, keys: list[str], arrays: dict[str, tuple[str, str | None]], width: int, *scalars: Column
) -> DataFrame:
    """Sums of ``array * factor`` per key, slot by slot: name -> (array column, factor column).

    Narrow arrays are summed as separate columns in generated code, wide ones by
    the vector summarizer; both combine partially before a shuffle.
    """
    if width * len(arrays) <= MAX_SUM_COLUMNS:

        def slot(array: str, factor: str | None, k: int) -> Column:
            return F.col(array)[k] if factor is None else F.col(array)[k] * F.col(factor)

        sums = [
            F.sum(slot(array, factor, k)).alias(f"_{name}{k}")
            for name, (array, factor) in arrays.items()
            for k in range(width)
        ]
        grouped = rows.groupBy(*keys).agg(*sums, *scalars)
        packed = {n: F.array(*[F.col(f"_{n}{k}") for k in range(width)]) for n in arrays}
        return grouped.withColumns(packed).drop(*[f"_{n}{k}" for n in arrays for k in range(width)])
    sums = [
        Summarizer.sum(array_to_vector(F.col(array) if factor is None else scale(array, factor))).alias(f"_{name}")
        for name, (array, factor) in arrays.items()
    ]
    grouped = rows.groupBy(*keys).agg(*sums, *scalars)
    return grouped.withColumns({n: vector_to_array(f"_{n}") for n in arrays}).drop(*[f"_{n}" for n in arrays])


def _dot(a: str, b: str, width: int) -> Column:
    """Inner product; unrolled for narrow arrays, because lambdas leave generated code."""
    if width > MAX_SUM_COLUMNS:
        return dot(a, b)
    terms = [F.col(a)[k] * F.col(b)[k] for k in range(width)]
    return reduce(lambda x, y: x + y, terms)


def _literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def project_rows(joined: DataFrame, hidden_bias: np.ndarray) -> DataFrame:
    """(doc, z) = sum over present columns of w_in * value, plus bias."""
    sums = summed_arrays(joined, ["doc"], {"z": ("w_in", "value")}, len(hidden_bias))
    return sums.select("doc", F.zip_with("z", _literal(hidden_bias), lambda z, b: z + b).alias("z"))


def encode_rows(joined: DataFrame, hidden_bias: np.ndarray) -> DataFrame:
    """(doc, hidden) = sigmoid of :func:`project_rows`."""
    return project_rows(joined, hidden_bias).select("doc", sigmoid_all("z").alias("hidden"))


def project(triples: DataFrame, table: DataFrame, hidden_bias: np.ndarray) -> DataFrame:
    """(doc, z): the sparse row times weight matrix product, before the activation."""
    if in_slices(table, len(hidden_bias)):
        return sliced_ae.encode(triples, table, hidden_bias, activated=False)
    return project_rows(Spread.of(triples).with_weights(table, len(hidden_bias), "w_in", by_doc=False), hidden_bias)


def encode(triples: DataFrame, table: DataFrame, hidden_bias: np.ndarray) -> DataFrame:
    """(doc, hidden) for every document."""
    if in_slices(table, len(hidden_bias)):
        return sliced_ae.encode(triples, table, hidden_bias)
    return encode_rows(Spread.of(triples).with_weights(table, len(hidden_bias), "w_in", by_doc=False), hidden_bias)


def reconstructed(
    spread: Spread, table: DataFrame, per_doc: DataFrame, width: int
) -> DataFrame:
    """Cells (doc, col, value, w_out, ..., out, error) from hidden vectors per document.

    out = sigmoid(W_out hidden + b_out) on the present columns only;
    error = (out - value) * out * (1 - out).
    """
    parts = spread.parts(table, width + 1, "w_out", "b_out")
    if len(parts) > 1:
        # Each part is joined to it: made once.
        per_doc = sealed(per_doc, "documents")
    cells = together([spread.with_documents(part, per_doc) for part in parts])
    cells = cells.withColumn("out", sigmoid(_dot("w_out", "hidden", width) + F.col("b_out")))
    return cells.withColumn("error", (F.col("out") - F.col("value")) * sigmoid_slope("out"))


def document_pass(
    spread: Spread, table: DataFrame, hidden_bias: np.ndarray
) -> DataFrame:
    """(doc, hidden, hidden_error, loss): forward and backward pass of every document.

    hidden_error = (W_out' error) * h * (1 - h); loss is the mean squared difference
    over the document's words.
    """
    width = len(hidden_bias)
    if in_slices(table, width):
        return sliced_ae.document_pass(spread.rows, table, hidden_bias)
    hidden = encode_rows(spread.with_weights(table, width, "w_in"), hidden_bias)
    cells = reconstructed(spread, table, hidden, width)
    diff = F.col("out") - F.col("value")
    # Every row of a document carries the same hidden vector; max of each slot keeps it
    # in a fixed-width aggregation buffer.
    same = [F.max(F.col("hidden")[k]).alias(f"_h{k}") for k in range(width)]
    back = summed_arrays(cells, ["doc"], {"back": ("w_out", "error")}, width, F.avg(diff * diff).alias("loss"), *same)
    back = back.withColumn("hidden", F.array(*[F.col(f"_h{k}") for k in range(width)]))
    error = F.zip_with("back", "hidden", lambda b, h: b * h * (1.0 - h))
    return back.select("doc", "hidden", error.alias("hidden_error"), "loss")


def decode(triples: DataFrame, table: DataFrame, hidden_bias: np.ndarray) -> DataFrame:
    """(doc, col, value, out): reconstruction of the columns present in each document."""
    if in_slices(table, len(hidden_bias)):
        return sliced_ae.decode(triples, table, hidden_bias)
    spread = Spread.of(triples)
    hidden = encode_rows(spread.with_weights(table, len(hidden_bias), "w_in"), hidden_bias)
    return reconstructed(spread, table, hidden, len(hidden_bias)).select("doc", "col", "value", "out")


def decode_hidden(hidden: DataFrame, triples: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """As :func:`decode`, from given hidden vectors (doc, hidden)."""
    if in_slices(table, width):
        return sliced_ae.decode_hidden(hidden, triples, table, width)
    return reconstructed(Spread.of(triples), table, hidden, width).select("doc", "col", "value", "out")


def output_error(pairs: DataFrame, ascending: bool = False) -> DataFrame:
    """(doc, col, error) from (doc, col, value, out); ``ascending`` takes value - out."""
    diff = F.col("value") - F.col("out") if ascending else F.col("out") - F.col("value")
    return pairs.select("doc", "col", (diff * sigmoid_slope("out")).alias("error"))


def column_gradients(
    spread: Spread, table: DataFrame, per_doc: DataFrame, width: int
) -> DataFrame:
    """(col, g_in, g_out, g_bias): gradients summed over all documents of ``per_doc``."""
    return summed_arrays(
        reconstructed(spread, table, per_doc, width),
        ["col"],
        {"g_in": ("hidden_error", "value"), "g_out": ("hidden", "error")},
        width,
        F.sum("error").alias("g_bias"),
    )


def bias_gradient(per_doc: DataFrame, width: int) -> DataFrame:
    """One row: summed hidden bias gradient, number of documents, mean document loss."""
    return summed_arrays(
        per_doc,
        [],
        {"g": ("hidden_error", None)},
        width,
        F.count(F.lit(1)).alias("docs"),
        F.avg("loss").alias("loss"),
    )


def updated_table(
    table: DataFrame, gradients: DataFrame, docs: Column, settings: SparseAutoencoderSettings
) -> DataFrame:
    """Descent on touched columns: w -= rate * (mean gradient + 2 decay w); others stay."""
    rate = settings.learning_rate

    def moved(weight: str, gradient: str, decay: float) -> Column:
        step = F.zip_with(weight, gradient, lambda w, g: w - rate * (g / F.col("_docs") + 2.0 * decay * w))
        return F.when(F.col(gradient).isNull(), F.col(weight)).otherwise(step)

    bias = F.when(F.col("g_bias").isNull(), F.col("b_out")).otherwise(
        F.col("b_out") - rate * (F.col("g_bias") / F.col("_docs") + settings.decay_bias * F.col("b_out"))
    )
    return table.join(gradients.withColumn("_docs", docs), "col", "left").select(
        "col",
        moved("w_in", "g_in", settings.decay_in).alias("w_in"),
        moved("w_out", "g_out", settings.decay_out).alias("w_out"),
        bias.alias("b_out"),
    )


def updated_bias(
    bias: np.ndarray, gradient: np.ndarray, docs: float, settings: SparseAutoencoderSettings
) -> np.ndarray:
    return bias - settings.learning_rate * (gradient / docs + 2.0 * settings.decay_bias * bias)


@dataclass(frozen=True)
class Step:
    """State after one update, the loss before it, and the pass the update reads (None where it read slices)."""

    table: DataFrame
    hidden_bias: np.ndarray
    loss: float
    per_doc: DataFrame | None


def step(
    spread: Spread,
    table: DataFrame,
    hidden_bias: np.ndarray,
    settings: SparseAutoencoderSettings,
) -> Step | None:
    """One update over all documents of ``spread``; None when there are none.

    Two jobs: the pass per document, written out, and the gradients per column
    joined into the new weight table.  Only the hidden bias visits the driver.
    """
    width = len(hidden_bias)
    if in_slices(table, width):
        slices = sliced_ae.cut(table, width)
        sliced = sliced_ae.step(sliced_ae.documents(spread.rows, slices), slices, hidden_bias, settings)
        return None if sliced is None else Step(sliced_ae.whole_table(sliced.slices), sliced.hidden_bias, sliced.loss, None)
    per_doc = seal(document_pass(spread, table, hidden_bias), "pass")
    measured = bias_gradient(per_doc, width).first()
    if not measured["docs"]:
        return None
    docs = float(measured["docs"])
    gradients = column_gradients(spread, table, per_doc, width)
    moved = updated_table(table, gradients, F.lit(docs), settings)
    bias = updated_bias(hidden_bias, np.array(measured["g"]), docs, settings)
    return Step(moved, bias, float(measured["loss"]), per_doc)


@dataclass
class SparseAutoencoderModel:
    settings: SparseAutoencoderSettings
    table: DataFrame
    hidden_bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    def encode(self, triples: DataFrame) -> DataFrame:
        return encode(triples, self.table, self.hidden_bias)

    def decode(self, triples: DataFrame) -> DataFrame:
        return decode(triples, self.table, self.hidden_bias)

    def save(self, path: str) -> None:
        """Write the weight table and the rest of the model where cleaning up a run does not reach."""
        about = {"settings": asdict(self.settings), "hidden_bias": self.hidden_bias.tolist(), "losses": self.losses}
        save_table_model(self.table.sparkSession, path, "sparse-autoencoder", self.table, about)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseAutoencoderModel:
        table, about = load_table_model(spark, path, "sparse-autoencoder")
        settings = SparseAutoencoderSettings(**about["settings"])
        return cls(settings, table, np.array(about["hidden_bias"]), about["losses"])


def train(
    triples: DataFrame,
    settings: SparseAutoencoderSettings,
    batches: int = 1,
    table: DataFrame | None = None,
    hidden_bias: np.ndarray | None = None,
) -> SparseAutoencoderModel:
    """``iterations`` passes of ``batches`` updates each, from random weights or the given ones.

    The triples are written once, in ranges of (batch, document hash) and sorted, so an
    update reads the row groups of its batch; each new weight table is
    written too, so the plan of a step never grows, and the table it replaces is
    deleted.  Updates use the mean gradient of a batch of documents; the result
    differs from a strictly serial document-by-document descent.  ``losses`` holds,
    per pass, the mean document loss met before each update.
    """
    if batches < 1:
        raise ValueError("at least one batch is needed")
    number = F.pmod(F.xxhash64("doc", F.lit(settings.seed)), F.lit(batches)).cast("int")
    thin = triples.select("doc", "col", "value")
    if batches > 1:
        tasks = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        ranged = thin.withColumn("_batch", number).repartitionByRange(tasks, "_batch", F.xxhash64("doc", "col"))
        thin = seal(ranged.sortWithinPartitions("_batch"), "triples")
    whole = Spread.of(thin)
    start = initial_weight_table(whole.rows, settings) if table is None else table
    table = seal(start, "weights")
    bias = initial_hidden_bias(settings) if hidden_bias is None else hidden_bias
    model = SparseAutoencoderModel(settings, table, bias)
    if in_slices(table, settings.hidden):
        return _train_sliced(model, thin, batches)
    for _ in range(settings.iterations):
        losses = []
        for batch in range(batches):
            part = whole if batches == 1 else whole.where(F.col("_batch") == batch)
            done = step(part, table, bias, settings)
            if done is None:
                continue
            old, table, bias = table, seal(done.table, "weights"), done.hidden_bias
            release(old)
            release(done.per_doc)
            losses.append(done.loss)
        if losses:
            model.losses.append(sum(losses) / len(losses))
    model.table, model.hidden_bias = table, bias
    return model


def _train_sliced(model: SparseAutoencoderModel, thin: DataFrame, batches: int) -> SparseAutoencoderModel:
    """The loop of :func:`train` on slices; the weights become one table again at the end."""
    settings = model.settings
    slices, bias = sliced_ae.cut(model.table, settings.hidden), model.hidden_bias
    release(model.table)
    parts = [thin if batches == 1 else thin.where(F.col("_batch") == k) for k in range(batches)]
    docs = [sliced_ae.documents(part, slices) for part in parts]
    for _ in range(settings.iterations):
        losses = []
        for part in docs:
            done = sliced_ae.step(part, slices, bias, settings)
            if done is not None:
                slices.release()
                slices, bias = done.slices, done.hidden_bias
                losses.append(done.loss)
        if losses:
            model.losses.append(sum(losses) / len(losses))
    for part in docs:
        release(part)
    model.table, model.hidden_bias = seal(sliced_ae.whole_table(slices), "weights"), bias
    slices.release()
    return model
