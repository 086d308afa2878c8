"""Quality rules: statistics against a plain version, and the learner on made labels."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featherloom.llm import quality

from .rows import ODD, docs, empty, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    three = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


TEXTS = [
    *ODD,
    (20, "one two three four\none two three four\n\none two three  four\nfive"),
    (21, "a b c a b c a b c d e f"),
    (22, "# * $ % & | < > é 你好 \x85 \x1c end"),
    (23, "a a a a a a"),
    (24, "a b a b a b x y z " * 30),
    (25, "x y z\n" + words(60) + "\nx y z\nx y z"),
]


def test_statistics_and_base_rules(spark):
    told, name = quality.judge(docs(spark, TEXTS), quality.DecisionList())
    v = F.col(name)
    rows = told.select(
        "doc_id", "text", *(v["s"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), v["base_failed"], v["kept"]
    ).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert tuple(r)[2:8] == plain(r["text"]), r["doc_id"]
        assert r[8] == (not r[7])


def labelled(spark):
    good = [(k, words(60 + k % 40, "good", k)) for k in range(200)]
    symbols = [(1000 + k, " ".join(f"{w}***" for w in words(60 + k % 30, "sym", k).split())) for k in range(60)]
    digits = [(2000 + k, words(40 + k % 9, "x", k) + " 11 22 33 44 55 66 77 88 99 10 12 13 14 15 16 17 18 19 20") for k in range(60)]
    rows = good + symbols + digits
    labels = [(i, int(i < 1000)) for i, _ in rows] + [(5000, 0), (None, 1), (1, None), (2, 7)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_covering_learns_conjunctions_that_separate(spark):
    table, labels = labelled(spark)
    rules = quality.learn(table, labels)
    assert 1 <= len(rules.rules) <= 6 and "reject" in str(rules)
    told, name = quality.judge(table, rules)
    wrong = told.where((F.col("doc_id") >= 1000) == F.col(name)["kept"]).count()
    assert wrong <= 3
    kept = quality.keep_good(table, rules)
    assert kept.columns == table.columns and kept.count() == told.where(F.col(name)["kept"]).count()


def test_rules_are_one_ordered_condition(spark):
    rule = quality.DecisionList(((quality.Condition(0, True, 5.0),), (quality.Condition(0, True, 3.0), quality.Condition(2, False, 1.0))))
    frame = spark.createDataFrame([([6.0, 0.0, 0.0],), ([4.0, 0.0, 0.0],), ([4.0, 0.0, 2.0],)], "v array<double>")
    assert [r[0] for r in frame.select(rule.rule(F.col("v"))).collect()] == [1, 2, 0]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_without_both_kinds_of_labels_nothing_is_learned(spark, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.learn(docs(spark, ODD), table) == quality.DecisionList()


def test_sample_is_bounded_and_deterministic(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(500)], "doc_id long, quality int")
    bounded = quality.QualitySettings(sample_rows=50)
    a, b = ({r["doc_id"] for r in quality.labelled_sample(x, bounded).collect()} for x in (labels, labels.repartition(7)))
    assert a == b and len(a) == 50


def test_empty_table(spark):
    assert quality.keep_good(empty(spark), quality.DecisionList()).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = quality.keep_good(docs(spark, ODD), quality.DecisionList(((quality.Condition(0, True, 5.0),),)))
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())
