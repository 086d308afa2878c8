"""Line templates and source mixing against plain versions."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from featherloom.llm import line_dedup, mixing

from .rows import ODD, docs, empty, words


def plain_templates(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line)
    t = ["<*>" if re.search(r"[0-9]|@|://", x) else x for x in w]
    n = len(t)
    if n < 5:
        return []
    if 3 * t.count("<*>") > n:
        return [(n, "=", tuple(w))]
    if n < 8:
        return [(n, tuple(t))]
    cuts = [2 + (n - 2) * j // 4 for j in range(5)]
    return [(n, j, tuple(t[: cuts[j]]), tuple(t[cuts[j + 1] :])) for j in range(4)]


def plain_dedupe(rows):
    where = defaultdict(set)
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            for t in plain_templates(line):
                where[t].add((doc, k))
    gone = set()
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            gone |= places - {min(places)}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (doc, k) not in gone]
        out.append((doc, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = [
    (1, "login of user ann accepted from 10.0.0.1 at 09:15 today\nown line of the first document here\nshort line"),
    (2, "login of user bob accepted from 10.0.0.2 at 10:30 today\nshort line\nown line of the second document here"),
    (3, "logout of user ann accepted from 10.0.0.1 at 09:15 today\n\nlogin of user ann accepted from 1.2.3.4 at 11:15 today"),
    (4, "Copyright 2019 by the Authors.\n" + words(60)),
    (5, "Copyright 2021 by the Authors.\n" + words(60) + "\n" + words(60)),
    (6, "twice in one document only so it stays here\ntwice in one document only so it stays here"),
    (8, "11 12 13 14 15 16 17 18 19 20\n1 a 2 b 3 c"),
    (9, "21 22 23 24 25 26 27 28 29 30\n4 a 5 b 6 c\n11 12 13 14 15 16 17 18 19 20"),
    (7, words(60, begin=0).replace("wordab", "other") + "\nlast"),
]


def test_templates_of_variable_fields_recur(spark):
    clean, counts = line_dedup.dedupe(docs(spark, LINES))
    got = [(r["doc_id"], r["text"], r[counts]["n_lines"], r[counts]["n_dropped"]) for r in clean.collect()]
    want = plain_dedupe(LINES)
    assert sorted(got, key=str) == want
    lost = {doc: n for doc, _, _, n in want}
    assert lost[2] == 1 and lost[5] == 3 and lost[6] == 0 and lost[7] == 1 and lost[1] == lost[4] == 0
    # Rows of numbers are no templates; only the same row recurs.
    assert lost[8] == 0 and lost[9] == 1


def test_odd_documents_and_columns(spark):
    rows = [r for r in ODD if r[0] is not None]
    table = docs(spark, ODD)
    clean, counts = line_dedup.dedupe(table)
    assert clean.columns == [*table.columns, counts] and counts not in table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in clean.where("doc_id is not null").collect()), key=str)
    assert got == sorted(((d, t) for d, t, _, _ in plain_dedupe(rows)), key=str)
    assert clean.count() == len(ODD)
    assert {r["text"] for r in clean.where("doc_id is null").collect()} == {None, ODD[10][1]}


def test_report_and_empty_table(spark):
    found = {r["documents"] for r in line_dedup.report(docs(spark, LINES)).collect()}
    assert 2 in found
    assert line_dedup.dedupe(empty(spark))[0].count() == 0


def test_lines_use_no_python(spark):
    plan = line_dedup.dedupe(docs(spark, LINES))[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Mixing.


def fill(capacity, weight, budget):
    """Budgets of siblings by repeated sharing: the rule told the slow way."""
    given = dict.fromkeys(capacity, 0.0)
    open_ = {k for k in capacity if weight[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weight[k] for k in open_)
        part = {k: left * weight[k] / total for k in open_}
        full = {k for k in open_ if given[k] + part[k] >= capacity[k] - 1e-9}
        for k in full or open_:
            more = capacity[k] - given[k] if k in full else part[k]
            given[k] += more
            left -= more
        open_ -= full
        if not full:
            break
    return given


TREE = {
    ("web", "en", "a"): 1000, ("web", "en", "b"): 50, ("web", "de", "a"): 100, ("books", "en", "c"): 30,
    ("books", "fr", "c"): 500, ("books", "fr", "d"): 0, ("", "", ""): 200,
}
WEIGHTS = {"domain": {"web": 0.6, "books": 0.3, "": 0.1}, "lang": {"en": 0.7, "de": 0.2}}


def plain_budgets(tree, settings):
    own = lambda level, v: settings.weights.get(level, {}).get(v, settings.other)

    def down(prefix, budget):
        k = len(prefix)
        if k == 3:
            return {prefix: budget}
        names = {p[k] for p in tree if p[:k] == prefix}
        capacity = {n: settings.epochs * sum(v for p, v in tree.items() if p[: k + 1] == (*prefix, n)) for n in names}
        given = fill(capacity, {n: own(settings.levels[k], n) for n in names}, min(budget, sum(capacity.values())))
        return {p: b for n in names for p, b in down((*prefix, n), given[n]).items()}

    return down((), settings.tokens)


@pytest.mark.parametrize("tokens", [0, 60, 700, 1500, 3000, 10_000])
def test_shortages_go_to_siblings_before_ancestors(spark, tokens):
    settings = mixing.MixSettings(weights=WEIGHTS, tokens=tokens)
    leaves = spark.createDataFrame([(*k, v) for k, v in TREE.items()], "domain string, lang string, source string, supply long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, settings).collect()}
    want = plain_budgets(TREE, settings)
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) <= 1.001, k


def plain_mix(rows, settings):
    tree = defaultdict(int)
    for _, leaf, n in rows:
        tree[leaf] += n
    out = defaultdict(int)
    for leaf, budget in plain_budgets(dict(tree), settings).items():
        budget, supply = int(budget + 1e-6), tree[leaf]
        own = [(d, n) for d, x, n in rows if x == leaf]
        whole = budget // supply if supply else 0
        rest = budget - whole * supply
        for d, _ in own:
            out[d] += whole
        if rest > 0 or not supply:
            order = sorted(own, key=lambda r: hashlib.md5(f"{settings.seed}:{whole}:{r[0]}".encode()).hexdigest())
            total = 0
            for d, n in order:
                total += n
                if total > rest:
                    break
                out[d] += 1
    return {k: v for k, v in out.items() if v}


def test_prefixes_of_seeded_epochs(spark):
    rows, table = [], []
    for k in range(900):
        leaf = [("web", "en", "hot"), ("web", "en", "b"), ("web", "de", "c"), ("books", "en", "d"), ("books", "", "")][min(4, k % 13 // 2)]
        n = k * 7 % 50
        rows.append((k, leaf, n))
        table.append((k, " ".join(["w"] * n), *(v or None for v in leaf)))
    frame = spark.createDataFrame(table, "doc_id long, text string, domain string, lang string, source string")
    for settings in (mixing.MixSettings(weights=WEIGHTS, tokens=15_000), mixing.MixSettings(weights=WEIGHTS, tokens=29_000, epochs=3)):
        taken, epoch = mixing.mix(frame, settings)
        got = defaultdict(list)
        for r in taken.collect():
            got[r["doc_id"]].append(r[epoch])
        assert {k: len(v) for k, v in got.items()} == plain_mix(rows, settings)
        assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_mixing_odd_rows_and_empty_tables(spark):
    table = docs(spark, ODD).withColumn("domain", F.lit(None).cast("string"))
    settings = mixing.MixSettings(share=1.0, epochs=1)
    taken, epoch = mixing.mix(table, settings)
    assert epoch not in table.columns and taken.columns == [*table.columns, epoch]
    assert taken.count() == len(ODD)
    assert mixing.mix(empty(spark), settings)[0].count() == 0


@pytest.mark.parametrize("weights", [{"lang": {"xx": 0.0}}, {"source": {"none": 0.0}}])
def test_weight_0_leaves_its_budget_to_others(spark, weights):
    """A domain that holds nothing but weight 0 has no budget: all of it goes to the other."""
    rows = [("d1", "xx" if "lang" in weights else "a", "none", 100), ("d2", "b", "s", 300)]
    leaves = spark.createDataFrame(rows, "domain STRING, lang STRING, source STRING, supply BIGINT")
    settings = mixing.MixSettings(weights={"domain": {"d1": 1.0, "d2": 1.0}, **weights}, tokens=200, epochs=1)
    got = {r["domain"]: r["budget"] for r in mixing.budgets(leaves, settings).collect()}
    assert got == {"d1": 0, "d2": 200}
