"""WARC records: exact round trips and linked derivatives."""

import gzip
import html
import json
import random
import re
import time

import pytest
from pyspark.sql import types as T

from featherloom.llm import warc
from featherloom.session import scratch_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("block", T.StringType())])

HTML = """<html><head><title>A &amp; B</title><style>p{}</style><script>var x = "<p>no</p>";</script></head>
<body><h1>Head</h1><p>One&nbsp;two <b>three</b></p><!-- unseen --><a href="/x?a=1&amp;b=2">link</a> <a class=c href=y>z</a></body></html>"""

ROWS = [
    (1, "http://a.example/x", HTML, "x"),
    (2, "http://a.example/y\r\nEvil: 1", "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\nWARC/1.1", "x"),
    (3, None, None, "x"),
    (4, "http://a.example/é", "", "x"),
    (None, "", "<p>über 你好</p>\r\n\r\n\r\n", "x"),
    (6, "http://a.example/long", "<p>" + "word " * 100_000 + "</p>", "x"),
    (1, "http://a.example/x", HTML, "x"),
]


def key(r):
    return json.dumps([r["type"], r["record_id"], bytes(r["block"][:50]).hex()])


def test_files_give_back_the_records(spark):
    records = warc.page_responses(spark.createDataFrame(ROWS, PAGES))
    path = scratch_path(spark, "warc")
    warc.write(records, path, warc.WarcSettings(rows_per_file=2))
    want = sorted((r.asDict(True) for r in records.collect()), key=key)
    got = sorted((r.asDict(True) for r in warc.read(spark, path).collect()), key=key)
    assert got == want and len(got) == len(ROWS)


def test_derivatives_are_linked(spark):
    responses = {r["record_id"]: r for r in warc.page_responses(spark.createDataFrame(ROWS, PAGES)).collect()}
    path = scratch_path(spark, "warc")
    warc.write(warc.derive(warc.page_responses(spark.createDataFrame(ROWS, PAGES))), path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == 2 * len(ROWS)
    for r in rows:
        source = responses[r["refers_to"]]
        own = {h["name"]: h["value"] for h in r["headers"]}
        theirs = {h["name"]: h["value"] for h in source["headers"]}
        assert own["WARC-Refers-To-Target-URI"] == source["uri"] == r["uri"]
        assert own["WARC-Source-Payload-Digest"] == theirs["WARC-Payload-Digest"] == warc.digest(warc.split_http(bytes(source["block"]))[1])
        assert own["WARC-Block-Digest"] == warc.digest(bytes(r["block"]))
        assert own["X-Page-Id"] == theirs["X-Page-Id"] and r["date"] == source["date"]
    by = {(r["type"], {h["name"]: h["value"] for h in r["headers"]}["X-Page-Id"]): r["block"].decode() for r in rows}
    assert by["conversion", "1"] == "A & B\nHead\nOne two three\nlink z"
    told = json.loads(by["metadata", "1"])
    assert told["title"] == "A & B" and told["links"] == ["/x?a=1&b=2", "y"] and told["http_headers"][1] == ["Content-Type", "text/html; charset=UTF-8"]
    assert by["conversion", "3"] == "" == by["conversion", "4"]


def test_other_records_pass_by_and_empty_tables(spark):
    none = warc.page_responses(spark.createDataFrame([], PAGES))
    assert warc.derive(none).count() == 0
    once = warc.derive(warc.page_responses(spark.createDataFrame(ROWS[:1], PAGES)))
    assert warc.derive(once).count() == 0
    path = scratch_path(spark, "warc")
    warc.write(none, path)
    assert warc.read(spark, path).count() == 0


@pytest.mark.parametrize(
    "unit", ["<script>x ", "<script ", "<title>x ", "<title ", "<a ", "<a href=", '<a href="x', "<a x='", "<p ", "<!-- ", "</script ", "<style></script>", "< ", "href="]
)
def test_a_megabyte_of_open_tags_is_read_in_no_time(unit):
    for page in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">"):
        begin = time.process_time()
        warc.plain_text(page), warc.title_of(page), warc.links_of(page)
        assert time.process_time() - begin < 10


def plain_pages():
    gen = random.Random(3)
    bits = ["<script>", "</script>", "<!--", "-->", "<p>", "</p>", "<a href='x>y'>", '<a class=b href="z">', "<a>", "text ", "<title>", "</title>", "<style>", "</style >", "<", ">", "&amp;", "\n"]
    return ["".join(gen.choice(bits) for _ in range(gen.randrange(30))) for _ in range(400)]


def test_the_scan_gives_what_plain_patterns_give():
    hidden = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
    title = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
    link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
    for page in plain_pages():
        assert warc.without_hidden(page) == hidden.sub(" ", page)
        m = title.search(page)
        assert warc.title_of(page) == (" ".join(html.unescape(re.sub(r"<[^<>]*>", "", m[1])).split()) if m else "")
        assert warc.links_of(page) == [html.unescape(next(x for x in g if x is not None)) for g in (m.groups() for m in link.finditer(page))]


def record(block, *headers, kind="response"):
    told = "".join(f"{h}\r\n" for h in ("WARC/1.1", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:1>", "WARC-Target-URI: http://a/", *headers))
    return told.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


LATIN = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html; charset=iso-8859-1\r\nSet-Cookie: b=2\r\n\r\n<p>caf\xe9</p>"
BROKEN = b"HTTP/1.1 200 OK\r\n\r\n<p>caf\xe9 \xff</p>"


def test_other_charsets_repeated_and_foreign_headers(spark, tmp_path):
    more = ["WARC-IP-Address: 10.0.0.1", "WARC-Concurrent-To: <urn:2>", "WARC-Concurrent-To: <urn:3>", "WARC-Truncated: length", "WARC-Payload-Digest: sha1:X"]
    one, two = record(LATIN, *more), record(BROKEN)
    # A member for each record, all in one member, and plain.
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one + two))
    (tmp_path / "c.warc").write_bytes(one + two)
    found = warc.read(spark, str(tmp_path))
    assert sorted(bytes(r["block"]) for r in found.collect()) == sorted([LATIN, BROKEN] * 3)
    out = warc.derive(found).collect()
    texts = sorted(r["block"].decode() for r in out if r["type"] == "conversion")
    assert texts == sorted(["café", "caf\ufffd \ufffd"] * 3)
    latin = [r for r in out if r["type"] == "metadata" and b"Set-Cookie" in r["block"]]
    for r in latin:
        assert [h for h in json.loads(r["block"])["http_headers"] if h[0] == "Set-Cookie"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"]]
        told = [(h["name"], h["value"]) for h in r["headers"]]
        assert all(tuple(m.split(": ")) in told for m in more[:4]) and ("WARC-Source-Payload-Digest", "sha1:X") in told
        assert [v for k, v in told if k == "WARC-Concurrent-To"] == ["<urn:2>", "<urn:3>"] and "WARC-Payload-Digest" not in dict(told)
    path = scratch_path(spark, "warc")
    warc.write(found, path)
    assert sorted(bytes(r["block"]) for r in warc.read(spark, path).collect()) == sorted([LATIN, BROKEN] * 3)


@pytest.mark.parametrize("part", [1, 7, 4_000_000])
def test_records_are_found_in_parts_of_any_size(monkeypatch, part):
    monkeypatch.setattr(warc, "PART_BYTES", part)
    blocks = [b"", b"x" * 50, b"WARC/1.1\r\n\r\n", LATIN]
    whole = b"".join(record(b) for b in blocks)
    assert [r["block"] for r in warc.parse(gzip.compress(whole))] == blocks
    assert [r["block"] for r in warc.parse(whole.rstrip())] == blocks
    for bad in (whole[:-20], b"nothing\r\n\r\n", gzip.compress(whole)[:-30]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
