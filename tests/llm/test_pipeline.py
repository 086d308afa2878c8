"""The corpus pipeline, stage by stage, against plain versions of its operators."""

import random
from dataclasses import replace

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from featherloom.llm import queries

from .rows import DOCS, words
from .test_lines_and_mixing import plain_dedupe, plain_mix
from .test_near_duplicates import brute, edited
from .test_quality import plain
from .test_tokens_and_packing import check_packed

DOMAINS = ("web", "books", "forums")


def corpus():
    rng = random.Random(9)
    rows = []

    def add(text, source=None, lang=None):
        rows.append((len(rows), text, lang or rng.choice(["en", "de", None]), source or f"src{rng.choice([0, 0, 0, 1, 2, 3])}"))

    for k in range(60):
        lines = [words(30, f"own{chr(97 + k % 26)}{chr(97 + k // 26)}", 30 * j) for j in range(3)]
        if k % 3 == 0:
            lines.append("This passage stands in every third document of all and has a number 123 in it")
        add("\n".join(lines))
    for k in range(8):
        add(rows[0][1])
        add(" ".join(edited(rng, rows[5][1].replace("\n", " ").split(), 3)))
    add(None)
    add("")
    add("too short")
    add("again and again and " * 50)
    add(words(60, "nosource"), source="other")
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table = [(i, t, lang, source, None if t is None else len(t), *(["x"] * 9)) for i, t, lang, source in corpus()]
    spark.createDataFrame(table, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_against_its_plain_version(spark, sf_dir, tmp_path):
    rows = corpus()
    about = {i: (lang, source) for i, _, lang, source in rows}
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    now = [(i, t) for i, t, _, _ in rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            now = [(i, t) for i, t in now if not plain(t)[-1]]
            assert 60 <= len(now) < len(rows)
        elif name == "line_dedup":
            told = plain_dedupe(now)
            now = [(i, t) for i, t, _, lost in told if not lost or t.split()]
            assert any(lost for *_, lost in told)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "minhash_near_dedup":
            kept = {i for i, _, _, ok in brute(now) if ok}
            assert len(kept) < len(now)
            now = [(i, t) for i, t in now if i in kept]
        elif name == "source_mix":
            counted = []
            for i, t in now:
                lang, source = about[i]
                number = int(source[3:]) if source[3:].isdigit() else 0
                counted.append((i, (DOMAINS[number % 3], lang or "", source), len(t.split())))
            total = sum(n for _, _, n in counted)
            taken = plain_mix(counted, replace(corpus_pipeline.MIX, tokens=int(total * 0.8)))
            assert 0 < len(taken) < len(now) and set(taken.values()) == {1}
            now = [(i, t) for i, t in now if i in taken]
        if k < 4:
            assert sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()) == sorted(now)
        else:
            check_packed(docs.collect(), now, 4096)


def test_short_lines_recur_and_leave_no_stub(spark):
    long = words(30)
    page = f"Home\n{long}\nBy Ann Lee"
    rows = [(1, page), (2, page), (3, f"Home\n{words(30, 'other')}\nPosted by user7 here\n12"), (4, f"{words(30, 'more')}\nPosted by user8 here\n13")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_recurring_lines(spark, table, "").collect()}
    # Masked as longer lines are; a line that is mostly field stands for itself.
    assert got == {1: page, 3: rows[2][1].removeprefix("Home\n"), 4: f"{words(30, 'more')}\n13"}


def test_run_gives_the_last_stage(spark, sf_dir):
    found = entry_point.queries()["pipeline"](spark, sf_dir)
    assert found.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_an_empty_corpus_passes(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_ten_queries_are_registered():
    names = entry_point.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
