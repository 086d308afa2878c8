"""WARC derivatives: responses in, linked metadata and plain-text conversion records out.

Records are rows (record_id, type, uri, date, refers_to, content_type, headers, block): ``headers`` holds the named fields
that have no column of their own, in order.  A file is one record after another, written by Spark's text sink with
the gap between records as its line end, so any file system Spark writes to will do; each task writes its rows and a lost
task is written again.  The reader takes whole files (bounded by ``rows_per_file``) and follows Content-Length, so a block
may hold anything, a record's first line included.

The builder makes of every response a ``conversion`` record with the page's text and a ``metadata`` record with its
title, links and HTTP headers as JSON.  Both carry WARC-Refers-To, WARC-Refers-To-Target-URI and -Date, the response's
digests as WARC-Source-Payload-Digest and WARC-Source-Block-Digest, and every other named field of the response; their own
block digests are computed anew.  Blocks are bytes: a page is decoded by the charset it declares (else UTF-8), what that
can't read becomes the replacement character, and derived blocks are UTF-8.  Pages are read in one forward scan.
Identifiers are hashes of what they name, so that a task that runs twice writes the same records.

Defined results: a null html or url counts as empty and still gives a response, a metadata record and a conversion with
an empty block; repeated pages give equal records; line breaks in a url or header are left out; other records
than responses pass the builder by; a script, style, comment or title without an end is left as text, a tag without
one too; a file that ends inside a record, or holds no record where one should begin, fails the read; an empty table gives no records; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.llm.words import schema_with, text_of

FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
RECORD = schema_with(
    ("record_id", T.StringType()),
    ("type", T.StringType()),
    ("uri", T.StringType()),
    ("date", T.StringType()),
    ("refers_to", T.StringType()),
    ("content_type", T.StringType()),
    ("headers", T.ArrayType(FIELD)),
    ("block", T.BinaryType()),
)

VERSION = "WARC/1.1"

#: Bytes inflated, and bytes of blocks handed on, at once.
PART_BYTES = 4_000_000

#: Compressed bytes inflated at once.
IN_BYTES = 1_000_000

GAP = "\r\n\r\n"


@dataclass(frozen=True)
class WarcSettings:
    """date: of the records; rows_per_file: records of a file at most; links: of a metadata record at most (0: all)."""

    date: str = "2024-01-01T00:00:00Z"
    rows_per_file: int = 2_000
    links: int = 0


#: All pairs of base-32 digits: 160 bits are sixteen of them.
_TWO = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(block: str | bytes) -> str:
    raw = block.encode() if isinstance(block, str) else block
    number = int.from_bytes(hashlib.sha1(raw).digest())
    return "sha1:" + "".join([_TWO[number >> k & 1023] for k in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    """A version-5 identifier of the parts."""
    raw = bytearray(hashlib.sha1("|".join(parts).encode()).digest()[:16])
    raw[6] = raw[6] & 0x0F | 0x50
    raw[8] = raw[8] & 0x3F | 0x80
    x = raw.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def page_responses(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Response records of (page_id, url, html): HTTP status and headers, then the page."""

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                uri, raw = one_line(url), body.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(raw)}\r\n\r\n"
                payload = digest(raw)
                headers = [
                    {"name": "WARC-Payload-Digest", "value": payload},
                    {"name": "WARC-Block-Digest", "value": digest(http.encode() + raw)},
                    {"name": "X-Page-Id", "value": "" if page is None else str(page)},
                ]
                kind = "application/http; msgtype=response"
                rows.append(("response", uri, "", kind, headers, http.encode() + raw, record_id("response", str(page), uri, payload)))
            yield _batch(rows, settings.date)

    picked = pages.select(F.col("page_id").cast("bigint"), text_of("url").alias("url"), text_of("html").alias("html"))
    return picked.mapInArrow(respond, RECORD)


_RECORD_ARROW = pa.schema(
    [
        *((name, pa.string()) for name in RECORD.names[:6]),
        ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("block", pa.binary()),
    ]
)


def _batch(rows: list[tuple], date: str | None = None) -> pa.RecordBatch:
    """Records from (type, uri, refers_to, content_type, headers, block, record_id[, date])."""
    return pa.RecordBatch.from_pylist(
        [
            {
                "record_id": r[6],
                "type": r[0],
                "uri": r[1],
                "date": date if date is not None else r[7],
                "refers_to": r[2],
                "content_type": r[3],
                "headers": r[4],
                "block": r[5],
            }
            for r in rows
        ],
        schema=_RECORD_ARROW,
    )


_HIDDEN = re.compile(r"<(script|style|noscript|template)\b|<!--", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title|body|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_TITLE = re.compile(r"<title\b", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def without_hidden(page: str) -> str:
    """The page with each script, style, template and comment as a space.

    What has no end after one place has none after a later one, so an end is looked for in vain once at most.
    """
    parts, at, begin, endless = [], 0, 0, set()
    while m := _HIDDEN.search(page, begin):
        name = (m[1] or "").lower()
        begin = m.end()
        if name in endless:
            continue
        if name:
            opened = page.find(">", begin)
            if opened < 0:
                break
            end = _ENDS[name].search(page, opened + 1)
            stop = end.end() if end else -1
        else:
            stop = page.find("-->", begin)
            stop = stop + 3 if stop >= 0 else -1
        if stop < 0:
            endless.add(name)
            continue
        parts += [page[at : m.start()], " "]
        at = begin = stop
    return "".join([*parts, page[at:]])


def plain_text(page: str) -> str:
    """The text of a page: blocks as lines, without scripts, styles, comments and tags."""
    seen = without_hidden(page)
    # No tag ends after the last ">": up to there every search for an end finds one.
    last = seen.rfind(">") + 1
    seen = _TAG.sub("", _BREAK.sub("\n", seen[:last])) + seen[last:]
    return "\n".join([" ".join(line.split()) for line in html.unescape(seen).split("\n") if line and not line.isspace()])


def title_of(page: str) -> str:
    m = _TITLE.search(page)
    opened = page.find(">", m.end()) if m else -1
    end = _ENDS["title"].search(page, opened + 1) if opened >= 0 else None
    return " ".join(html.unescape(_TAG.sub("", page[opened + 1 : end.start()])).split()) if end else ""


def links_of(page: str) -> list[str]:
    """Targets of the anchors; each tag is read once."""
    found, begin = [], 0
    while m := _ANCHOR.search(page, begin):
        end = page.find(">", m.end())
        if end < 0:
            break
        named = _HREF.search(page, m.end(), end)
        value = _VALUE.match(page, named.end()) if named else None
        begin = max(value.end() if value else end, m.end())
        if value:
            found.append(html.unescape(next(x for x in value.groups() if x is not None)))
    return found


def described(page: str, size: int, http: list[tuple[str, str]], settings: WarcSettings) -> str:
    """Metadata of a page of ``size`` bytes as JSON."""
    links = links_of(page)
    links = links[: settings.links] if settings.links else links
    return json.dumps({"title": title_of(page), "links": links, "http_headers": http, "html_bytes": size}, ensure_ascii=False)


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP headers in order (the status line under ``status``) and the payload."""
    head, gap, body = block.partition(GAP.encode())
    if not gap or not head.startswith(b"HTTP/"):
        return [], block
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    return [("status", status), *((k.strip(), v.strip()) for k, _, v in (f.partition(":") for f in fields))], body


def decoded(payload: bytes, http: list[tuple[str, str]]) -> str:
    """A page as text, by the charset of its Content-Type or of its first 1024 bytes, else as UTF-8."""
    declared = [v for k, v in http if k.lower() == "content-type"]
    for told in (*declared, payload[:1024].decode("latin-1")):
        m = _CHARSET.search(told)
        if m:
            try:
                return payload.decode(m[1], "replace")
            except (LookupError, ValueError):
                continue
    return payload.decode("utf-8", "replace")


#: Fields of a response that its derivatives carry under other names or not at all.
_OWN = {"warc-payload-digest", "warc-block-digest", "warc-refers-to-target-uri", "warc-refers-to-date"}
_OWN |= {"warc-source-payload-digest", "warc-source-block-digest"}


def derive(records: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Metadata and conversion records of the responses among ``records``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = {f["name"].lower(): f["value"] for f in r["headers"]}
                http, payload = split_http(r["block"])
                page = decoded(payload, http)
                linked = [
                    {"name": "WARC-Refers-To-Target-URI", "value": r["uri"]},
                    {"name": "WARC-Refers-To-Date", "value": r["date"]},
                    {"name": "WARC-Source-Payload-Digest", "value": own.get("warc-payload-digest") or digest(payload)},
                    {"name": "WARC-Source-Block-Digest", "value": own.get("warc-block-digest") or digest(r["block"])},
                ]
                linked += [f for f in r["headers"] if f["name"].lower() not in _OWN]
                for kind, content_type, block in (
                    ("metadata", "application/json", described(page, len(payload), http, settings).encode("utf-8", "replace")),
                    ("conversion", "text/plain; charset=UTF-8", plain_text(page).encode("utf-8", "replace")),
                ):
                    headers = [*linked, {"name": "WARC-Block-Digest", "value": digest(block)}]
                    rows.append((kind, r["uri"], r["record_id"], content_type, headers, block, record_id(kind, r["record_id"]), r["date"]))
            yield _batch(rows)

    return records.where(F.col("type") == "response").select(*RECORD.names).mapInArrow(build, RECORD)


def write(records: DataFrame, path: str, settings: WarcSettings = WarcSettings()) -> None:
    """Write records as gzip-compressed WARC files under ``path``."""

    def line(name: str, value) -> F.Column:
        return F.when(value != "", F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit(""))

    more = F.array_join(F.transform("headers", lambda f: F.concat(F.lit("\r\n"), f["name"], F.lit(": "), f["value"])), "")
    text = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.col("type"),
        F.lit("\r\nWARC-Record-ID: "),
        F.col("record_id"),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("Content-Type", F.col("content_type")),
        more,
        F.lit("\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(GAP),
        # The bytes as they are: the sink writes what a string holds.
        F.col("block").cast("string"),
    )
    writer = records.select(text.alias("value")).write.option("lineSep", GAP).option("compression", "gzip")
    # Most of the work of a write is its compression.
    writer = writer.option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", settings.rows_per_file).mode("errorifexists").text(path)


_NAMED = {
    "warc-type": "type",
    "warc-record-id": "record_id",
    "warc-target-uri": "uri",
    "warc-date": "date",
    "warc-refers-to": "refers_to",
    "content-type": "content_type",
}


def inflated(content: bytes) -> Iterator[bytes]:
    """A file's bytes in parts: gzip members one after another, or plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, rest = memoryview(content), 0, b""
    inflate = zlib.decompressobj(wbits=31)
    while rest or at < len(view):
        if not rest:
            rest, at = bytes(view[at : at + IN_BYTES]), at + IN_BYTES
        if inflate.eof:
            inflate = zlib.decompressobj(wbits=31)
        yield inflate.decompress(rest, PART_BYTES)
        rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    while not inflate.eof:
        part = inflate.decompress(b"", PART_BYTES)
        if not part:
            raise ValueError("a compressed member has no end")
        yield part


def parse(content: bytes) -> Iterator[dict]:
    """Records of a file's bytes; in memory are the file, a part of what it inflates to and one record."""
    held, parts, gap = bytearray(), inflated(content), GAP.encode()

    def fill() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        stop = held.find(gap)
        searched = 0
        while stop < 0:
            searched = max(0, len(held) - len(gap) + 1)
            if not fill():
                if held.strip():
                    raise ValueError("no record where one should begin")
                return
            stop = held.find(gap, searched)
        version, *fields = held[:stop].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        record: dict = dict.fromkeys(RECORD.names, "") | {"headers": []}
        size = 0
        for f in fields:
            name, _, value = f.partition(":")
            name, value = name.strip(), value.strip()
            if name.lower() == "content-length":
                size = int(value)
            elif name.lower() in _NAMED:
                record[_NAMED[name.lower()]] = value
            else:
                record["headers"].append({"name": name, "value": value})
        begin = stop + len(gap)
        while len(held) < begin + size:
            if not fill():
                raise ValueError("the file ends inside a record")
        record["block"] = bytes(held[begin : begin + size])
        yield record
        while len(held) < begin + size + len(gap) and fill():
            pass
        del held[: begin + size + len(gap)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse(content.as_py()):
                    rows.append(record)
                    held += len(record["block"])
                    if len(rows) == 500 or held > PART_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(records, RECORD)
