"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions.

Everything here is DataFrame expressions.  The text statistics are computed inside each row, so no text is
shuffled.  The learner sees only the statistics of a bounded sample of labelled rows: each grow step is one
grouped count over (statistic, bin), of which at most a few hundred rows reach the driver.

Defined results: a null text counts as empty; an empty text has all statistics 0 and fails the base rules; rows with
a null or repeated key are judged row by row; labels other than 0 and 1 are ignored, and a key labelled both ways
counts as rejected; without labels of both kinds the list is empty and only the base rules reject; equal
statistics get equal verdicts; extra columns are passed through, and a clash of names can't occur because the
statistics travel in one column with a free name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.llm.words import WORD, free_name, let, share_of_long, text_of, words_of
from featherloom.session import release, seal

#: Statistics that the rules may test, in the order of the vector the learner sees.  All are shares of a text: lengths
#: of texts and words tell languages and topics apart as well as junk, so a rule on them would not carry over.
TESTED = (
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "upper_share",
    "digit_share",
    "stress_per_word",
)


@dataclass(frozen=True)
class QualitySettings:
    """Bounds and limits of the learner.

    sample_rows: labelled rows learned from, the first by a hash of the key.
    bins: thresholds per statistic and class (quantiles).
    max_rules, max_conditions: size of the list.
    min_precision: share of true rejects a rule needs, on grow and on prune rows.
    min_cover: prune rows a rule must cover.
    """

    sample_rows: int = 50_000
    bins: int = 16
    max_rules: int = 6
    max_conditions: int = 3
    min_precision: float = 0.95
    min_cover: int = 5
    seed: int = 7


@dataclass(frozen=True)
class Condition:
    """``statistic >= threshold`` or ``statistic < threshold``."""

    statistic: int
    at_least: bool
    threshold: float

    def on(self, vector: Column) -> Column:
        value = F.get(vector, F.lit(self.statistic))
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{TESTED[self.statistic]} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction that rejects; rows that no rule takes are kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rule(self, vector: Column) -> Column:
        """Number (from 1) of the first rule that takes the row, 0 if none does."""
        out = None
        for number, conditions in enumerate(self.rules, 1):
            whole = all_of(conditions, vector)
            out = F.when(whole, number) if out is None else out.when(whole, number)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        lines = ["if " + " and ".join(map(str, r)) + ": reject" for r in self.rules]
        return "\n".join([*lines, "otherwise: keep"])


def all_of(conditions: tuple[Condition, ...] | list[Condition], vector: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.on(vector)
    return out


def places_of_repeats(keyed: Column) -> Column:
    """Places whose key occurs twice or more in an array of (key, place): equal neighbours after a sort."""

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["key"] == F.get(s, b)["key"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.transform(hits, lambda k: F.get(s, k)["place"])

    none = F.array().cast("array<int>")
    return F.when(F.size(keyed) == 0, none).otherwise(let(F.sort_array(keyed), repeated))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Hashes of the windows clear the texts without a repeat; in the others they choose the windows whose words
    are then compared as they are.
    """
    three = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def exact(candidates: Column) -> Column:
        windows = F.transform(
            candidates, lambda p: F.struct(F.concat_ws(" ", *three(p)).alias("key"), p.alias("place"))
        )
        return let(
            let(windows, places_of_repeats),
            lambda places: F.size(
                F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + F.lit(1), p + F.lit(2)))))
            ),
        )

    def looked_at(hashes: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("place")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(keyed, places_of_repeats), exact)
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*three(i)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, looked_at))


def only(text: Column, kept: str) -> Column:
    """Number of characters of ``text`` in the class ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def statistics(text: str | Column = "text") -> Column:
    """One struct with every statistic of a text."""

    def counted(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
        return F.struct(
            let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"))).alias("w"),
            F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
            only(t, r"#*$%&|<>").alias("n_symbols"),
            let(
                lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
            ).alias("lines"),
            only(t, r"\p{Lu}").alias("upper"),
            only(t, "0-9").alias("digits"),
            only(t, "!?").alias("stress"),
        )

    def named(s: Column) -> Column:
        n = s["w"]["n"]
        per = lambda x, by: F.when(by > 0, x / by).otherwise(F.lit(0.0)).cast("double")
        return F.struct(
            n.cast("bigint").alias("n_words"),
            s["word_chars"].cast("bigint").alias("word_chars"),
            s["n_symbols"].cast("bigint").alias("n_symbols"),
            s["lines"]["dup"].cast("bigint").alias("n_dup_lines"),
            s["w"]["repeat"].cast("bigint").alias("n_repeat_words"),
            F.array(
                per(s["n_symbols"], n),
                per(s["lines"]["dup"], s["lines"]["n"]),
                per(s["w"]["repeat"], n),
                per(s["upper"], s["word_chars"]),
                per(s["digits"], s["word_chars"]),
                per(s["stress"], n),
            ).alias("tested"),
        )

    return let(let(text_of(text), counted), named)


def base_failed(s: Column) -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def labelled_sample(labels: DataFrame, settings: QualitySettings, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, rejected) of at most ``sample_rows`` labelled keys, the first by hash."""
    clean = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("quality"))
    clean = clean.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    one = clean.groupBy("doc_id").agg((1 - F.min("quality")).alias("rejected"))
    draw = F.xxhash64(F.lit(settings.seed), F.col("doc_id"))
    # Half as many again as wanted by their hash first: a bare limit would send that many rows from every task.
    total = one.count()
    if total > 2 * settings.sample_rows:
        one = one.where(share_of_long(draw) < F.lit(1.5 * settings.sample_rows / total))
    return one.orderBy(draw, "doc_id").limit(settings.sample_rows)


def learn(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DecisionList:
    """Decision list from the labelled documents."""
    sample = labelled_sample(labels, settings)
    texts = docs.select(F.col("doc_id"), F.col("text"))
    #: The sample is broadcast: at most ``sample_rows`` rows of a key and a flag.
    known = texts.join(F.broadcast(sample), "doc_id")
    prune = share_of_long(F.xxhash64(F.lit(settings.seed + 1), F.col("doc_id"))) < F.lit(1 / 3)
    table = seal(
        known.select("rejected", prune.alias("prune"), statistics("text")["tested"].alias("tested")), "quality-sample"
    )
    try:
        return cover(table, settings)
    finally:
        release(table)


def thresholds(table: DataFrame, settings: QualitySettings) -> list[list[float]]:
    """Candidate thresholds per statistic: smallest, largest and quantiles of either class among these rows."""
    points = [0.0, *((k + 0.5) / settings.bins for k in range(settings.bins)), 1.0]
    aggregates = [
        F.percentile_approx(F.when(F.col("rejected") == y, F.get("tested", F.lit(f))), points, 1000).alias(f"t{f}_{y}")
        for f in range(len(TESTED))
        for y in (0, 1)
    ]
    row = table.agg(*aggregates).first()
    return [sorted({*(row[f"t{f}_0"] or ()), *(row[f"t{f}_1"] or ())}) for f in range(len(TESTED))]


def bins_of(vector: Column, cuts: list[list[float]]) -> Column:
    """For each statistic how many of its thresholds the value reaches."""

    def reached(points: list[float], f: int) -> Column:
        if not points:
            return F.lit(0)
        return F.size(F.filter(F.array(*map(F.lit, points)), lambda t: t <= F.get(vector, F.lit(f))))

    return F.array(*(reached(points, f) for f, points in enumerate(cuts)))


def step_counts(table: DataFrame, taken: Column, bins: Column) -> list:
    """Rows (prune, statistic, bin, rejects, n) of the rows in ``taken``: a few hundred at most."""
    return (
        table.where(taken)
        .select("prune", "rejected", F.posexplode(bins).alias("statistic", "bin"))
        .groupBy("prune", "statistic", "bin")
        .agg(F.sum("rejected").alias("rejects"), F.count(F.lit(1)).alias("n"))
        .collect()
    )


def totals(counts: list, prune: bool) -> tuple[int, int]:
    """Rejects and kept rows among the grow or prune rows."""
    own = [c for c in counts if c["prune"] == prune and c["statistic"] == 0]
    rejects = sum(c["rejects"] for c in own)
    return rejects, sum(c["n"] for c in own) - rejects


def best_condition(counts: list, cuts: list[list[float]], rejects: int, kept: int) -> tuple[float, Condition] | None:
    """The condition of most information gain on the grow rows."""
    best = None
    before = math.log2(rejects / (rejects + kept))
    for f, points in enumerate(cuts):
        below_rejects = below_n = 0
        by_bin = {c["bin"]: c for c in counts if not c["prune"] and c["statistic"] == f}
        for b, point in enumerate(points):
            c = by_bin.get(b)
            below_rejects += c["rejects"] if c else 0
            below_n += c["n"] if c else 0
            for at_least, p, n in ((False, below_rejects, below_n), (True, rejects - below_rejects, rejects + kept - below_n)):
                if p:
                    gain = p * (math.log2(p / n) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Condition(f, at_least, point)
    return best


def cover(table: DataFrame, settings: QualitySettings) -> DecisionList:
    """Sequential covering over (rejected, prune, tested): grow, prune, accept, and go on with the rest."""
    vector = F.col("tested")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < settings.max_rules:
        left = F.lit(True)
        for r in rules:
            left = left & ~all_of(r, vector)
        cuts = thresholds(table.where(left), settings)
        bins = bins_of(vector, cuts)
        grown: list[Condition] = []
        seen: list[tuple[int, int]] = []
        while True:
            counts = step_counts(table, left & all_of(grown, vector), bins)
            rejects, kept = totals(counts, False)
            if grown:
                seen.append(totals(counts, True))
            if not rejects or not kept or len(grown) == settings.max_conditions:
                break
            found = best_condition(counts, cuts, rejects, kept)
            if found is None:
                break
            grown.append(found[1])
        if not grown:
            break
        # Prune: the prefix of most precision (add-one) on the rows kept back.
        worth = [(p + 1) / (p + n + 2) for p, n in seen]
        length = max(range(len(worth)), key=lambda k: (round(worth[k], 9), -k)) + 1
        p, n = seen[length - 1]
        if p + n < settings.min_cover or p < settings.min_precision * (p + n):
            break
        rules.append(tuple(grown[:length]))
    return DecisionList(tuple(rules))


def verdict(rules: DecisionList, text: str | Column = "text") -> Column:
    """Struct (s: the statistics, base_failed, rule, kept) of a text, as one expression."""

    def judged(s: Column) -> Column:
        def told(x: Column) -> Column:
            return F.struct(
                s.alias("s"),
                x["failed"].alias("base_failed"),
                x["rule"].alias("rule"),
                (~x["failed"] & (x["rule"] == 0)).alias("kept"),
            )

        return let(F.struct(base_failed(s).alias("failed"), rules.rule(s["tested"]).alias("rule")), told)

    return let(statistics(text), judged)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: the verdict on each text."""
    name = free_name(docs, "text_verdict")
    return docs.withColumn(name, verdict(rules, text)), name


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The documents that the base rules and the list keep, with the columns they came with."""
    return docs.where(verdict(rules, text)["kept"])
