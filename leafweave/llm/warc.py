"""WARC derivatives: metadata and plain-text conversion records of responses.

``write`` stores records as WARC/1.1 files, each record a gzip member of its
own.  ``read`` gives a file's records back, of versions 1.0 and 1.1, by member
or plain; header names are matched in any case, and a header that is repeated
keeps all its values, apart by commas.  A file that breaks off gives the
records before the break.  ``derive`` makes two records of
every response: a metadata record (title, links, the source's HTTP headers)
and a conversion record (the page's visible text), both of which refer to the
response by its identifier and carry its payload digest, and a block digest of
their own.  Identifiers come from content by name, so a retried task makes the
same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import workdir

VERSION = b"WARC/1.1"
VERSIONS = (VERSION, b"WARC/1.0")
#: Date of records that have none of their own.
DATE = "2024-01-01T00:00:00Z"
#: Level of compression: 4 made files 1 % larger than 6 and took two thirds of its time.
LEVEL = 4
RECORD = "record_id string, type string, uri string, date string, headers map<string,string>, block binary"
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_HIDDEN = frozenset("script style template noscript".split())
#: What well-formed pages consist of beside text; a page with any other "<" goes to the parser.
_ATTRIBUTE = r"""[ \t\n]+([a-zA-Z][a-zA-Z0-9:_-]*)(?:=(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>=`/]+)(?=[\s>]|$)))?"""
_ATTRIBUTES = re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE)
_TOKEN = re.compile(
    r"<(?!(?:script|style|title|textarea|xmp|iframe|noembed|noframes|plaintext|svg|math)\b|(?:template|noscript)\b[^>]*/>)(/?)([a-z][a-z0-9-]*)"
    rf"((?:{_ATTRIBUTES})*)[ \t\n]*/?>|<title>([^<]*)</title>|<!DOCTYPE html>|<!--[^<>-]*(?:-[^<>-]+)*-->"
    rf"|<script(?:{_ATTRIBUTES})*>[^<]*(?:<(?!(?i:/?script)|!)[^<]*)*</script>|<style(?:{_ATTRIBUTES})*>[^<]*(?:<(?!(?i:/?style)|!)[^<]*)*</style>"
)
_ATTRIBUTE = re.compile(_ATTRIBUTE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join((kind, *parts)))}>"


class _Page(HTMLParser):
    """Visible text, title and links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.hidden = 0
        self.in_title = False

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed, and counting them takes time."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag in _BLOCKS:
            self.text.append("\n")
        for name, value in attrs:
            if tag == "a" and name == "href" and value:
                self.links.append(value)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCKS:
            self.text.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)


def _read(html: str) -> _Page:
    """A page of well-formed tokens only, read token by token, else by the parser; both give the same."""
    page, parts = _Page(), _TOKEN.split(html)
    texts = parts[::5]
    if any("<" in t for t in texts):
        page.feed(html)
        page.close()
        return page
    out = page.text
    for text, close, tag, attributes, title in zip(texts, [None, *parts[1::5]], [None, *parts[2::5]], [None, *parts[3::5]], [None, *parts[4::5]], strict=True):
        if tag:
            if tag in _BLOCKS:
                out.append("\n")
            elif tag in _HIDDEN:
                page.hidden = max(0, page.hidden - 1) if close else page.hidden + 1
            elif tag == "a" and attributes and not close:
                found = ((m[1], m[2] or m[3] or m[4]) for m in _ATTRIBUTE.finditer(attributes))
                page.links += [unescape(v) for k, v in found if v and k.lower() == "href"]
        elif title:
            page.title.append(unescape(title))
        if text and not page.hidden:
            out.append(unescape(text) if "&" in text else text)
    return page


def convert(html: str) -> tuple[str, str, list[str]]:
    """(visible text with a line for each block, title, links)."""
    page = _read(html)
    lines = (" ".join(x.split()) for x in "".join(page.text).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(page.title).split()), page.links


def response(page_id: int | None, url: str | None, html: str | None) -> dict:
    """A response record of a page; a null address or page counts as empty."""
    payload = (html or "").encode("utf-8")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode()
    block = head + payload
    rid = record_id("response", str(page_id), url or "", digest(payload))
    headers = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http;msgtype=response"}
    return {"record_id": rid, "type": "response", "uri": url or "", "date": DATE, "headers": headers, "block": block}


def derived(r: dict) -> list[dict]:
    """The metadata and the conversion record of a response; none of other records."""
    if r["type"] != "response":
        return []
    given = dict(r["headers"])
    head, _, payload = r["block"].partition(b"\r\n\r\n")
    source = [x for x in head.decode("latin-1").split("\r\n")[1:] if ":" in x]
    text, title, links = convert(_decoded(source, payload))
    payload_digest = given.get("WARC-Payload-Digest") or digest(payload)
    out = []
    fields = [f"title: {title}", *[f"source-header: {x}" for x in source], *[f"outlink: {x}" for x in links]]
    for kind, mime, body in (("metadata", "application/warc-fields", "\r\n".join(map(_clean, fields)) + "\r\n"), ("conversion", "text/plain; charset=utf-8", text)):
        block = body.encode("utf-8", "replace")
        headers = {"WARC-Refers-To": r["record_id"], "WARC-Refers-To-Target-URI": r["uri"], "WARC-Refers-To-Date": r["date"], "WARC-Source-Payload-Digest": payload_digest, "WARC-Block-Digest": digest(block), "Content-Type": mime}
        out.append({"record_id": record_id(kind, r["record_id"]), "type": kind, "uri": r["uri"], "date": r["date"], "headers": headers, "block": block})
    return out


def _decoded(headers: list[str], payload: bytes) -> str:
    """A payload's text: chunks joined, gzip or deflate undone, by the header's character set or else as UTF-8."""
    given = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in headers)}
    if "chunked" in given.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    if (kind := given.get("content-encoding", "").lower()) in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(31 if "gzip" in kind else 15).decompress(payload)
        except zlib.error:
            pass  # some servers name an encoding that they didn't use
    found = re.search(r"charset=[\"']?([A-Za-z0-9._-]+)", given.get("content-type", ""), re.I)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _unchunked(payload: bytes) -> bytes:
    """The chunks of a body, as far as they are well formed; a body without chunks as it is."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(payload, at):
        size = int(m[1], 16)
        out.append(payload[m.end() : m.end() + size])
        at = m.end() + size + 2
        if not size:
            break
    return b"".join(out) if at else payload


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


def serialise(r: dict) -> bytes:
    lines = [f"WARC-Type: {r['type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {_clean(r['uri'])}"]
    lines += [f"{k}: {_clean(v)}" for k, v in sorted(dict(r["headers"]).items())]
    head = "\r\n".join([VERSION.decode(), *lines, f"Content-Length: {len(r['block'])}"])
    return head.encode("utf-8") + b"\r\n\r\n" + r["block"] + b"\r\n\r\n"


#: Headers that are a record's own fields.
_FIELDS = {"warc-record-id": "record_id", "warc-type": "type", "warc-target-uri": "uri", "warc-date": "date"}


def _head(head: bytes) -> tuple[dict, dict, int]:
    """(fields, other headers, length of the block) of a record's head."""
    first, *lines = head.split(b"\r\n" if b"\r\n" in head else b"\n")
    if first.strip() not in VERSIONS:
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields, headers, size = {"uri": "", "date": "", "type": "", "record_id": ""}, {}, 0
    joined: list[str] = []
    for line in (x.decode("utf-8", "replace") for x in lines):
        if line[:1] in (" ", "\t") and joined:  # a folded line goes on
            joined[-1] += " " + line.strip()
        elif line:
            joined.append(line)
    for line in joined:
        name, _, value = line.partition(":")
        name, value = name.strip(), value.strip()
        if name.lower() == "content-length":
            size = int(value)
        elif name.lower() in _FIELDS:
            fields[_FIELDS[name.lower()]] = value
        else:
            known = next((k for k in headers if k.lower() == name.lower()), name)
            headers[known] = f"{headers[known]}, {value}" if known in headers else value
    return fields, headers, size


def parse(member: bytes) -> dict:
    """A record from its bytes."""
    (record,) = records(iter([member]))
    return record


def records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of a stream of bytes, each as soon as it is whole."""
    held = b""
    while True:
        held = held.lstrip(b"\r\n")
        end = next((at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := held.find(gap)) >= 0), 0)
        if end:
            fields, headers, size = _head(held[:end].rstrip(b"\r\n"))
            parts, have = [held[end:]], len(held) - end
            while have < size and (more := next(pieces, b"")):
                parts.append(more)
                have += len(more)
            if have < size:
                return
            rest = b"".join(parts)
            yield {**fields, "headers": headers, "block": rest[:size]}
            held = rest[size:]
        elif more := next(pieces, b""):
            held += more
        else:
            return


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a file, of gzip members or plain, in pieces."""
    raw = stream.read(1 << 20)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(1 << 20)
        return
    inflate = zlib.decompressobj(31)
    while raw:
        try:
            yield inflate.decompress(raw)
        except zlib.error:  # broken from here on
            return
        raw = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            inflate = zlib.decompressobj(31)
            raw = raw.lstrip(b"\0")
        raw = raw or stream.read(1 << 20)


_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = {f.name: [r[f.name] for r in rows] for f in _SCHEMA}
    columns["headers"] = [list(dict(h).items()) for h in columns["headers"]]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            yield from batch.slice(lo, 500).to_pylist()


def _batches(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(records, 500)):
        yield _batch(held)


def _responses(pages: Iterator[dict]) -> Iterator[dict]:
    return (response(r["page_id"], r["url"], r["html"]) for r in pages)


def _derived(records: Iterator[dict]) -> Iterator[dict]:
    return (d for r in records for d in derived(r))


def _held(paths: Iterator[dict]) -> Iterator[dict]:
    """Records of the files, one at a time."""
    for row in paths:
        fs, at = workdir.open_fs(row["path"])
        with fs.open_input_stream(at, compression=None) as stream:
            yield from records(piece for piece in inflated(stream) if piece)


def _written(records: Iterator[dict], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes a task's records to its file; path and n_records unless there are none."""
    import os

    from pyspark import TaskContext

    context = TaskContext.get()
    fs, root = workdir.open_fs(folder)
    fs.create_dir(root, recursive=True)
    name = f"part-{context.partitionId():06d}.warc.gz"
    mine, n = f"{root}/.{name}.{context.taskAttemptId()}-{os.getpid()}", 0
    with fs.open_output_stream(mine, compression=None) as out:
        for r in records:
            out.write(gzip.compress(serialise(r), LEVEL, mtime=0))
            n += 1
    if not n:
        fs.delete_file(mine)
        return
    fs.move(mine, f"{root}/{name}")
    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})


def _files(rows: DataFrame, records: Callable[[Iterator[dict]], Iterator[dict]], folder: str) -> DataFrame:
    """Files of the records made from the rows, in the task that reads them."""
    found = rows.mapInArrow(lambda batches: _written(records(_rows(batches)), folder), "path string, n_records long").collect()  # a row for each file
    return rows.sparkSession.createDataFrame(sorted((r["path"], r["n_records"]) for r in found), "path string, n_records long")


def _columns(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


def _dealt(files: DataFrame) -> DataFrame:
    return files.select("path").repartition(max(1, files.count()))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html)."""
    return _columns(pages).mapInArrow(lambda batches: _batches(_responses(_rows(batches))), RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all responses."""
    return records.mapInArrow(lambda batches: _batches(_derived(_rows(batches))), RECORD)


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each partition; returns path and n_records of those that have any."""
    return _files(records, iter, folder)


def read(files: DataFrame) -> DataFrame:
    """All records of the files, a task for each file, a record at a time."""
    return _dealt(files).mapInArrow(lambda batches: _batches(_held(_rows(batches))), RECORD)


def derivatives(pages: DataFrame) -> DataFrame:
    """Derived records, through response files and derivative files.

    A null address or page counts as empty and still has its three records; a
    repeated row repeats its records; an empty table gives none.
    """
    spark = pages.sparkSession
    source = _files(_columns(pages), _responses, workdir.new_folder(spark, "warc-responses"))
    made = _files(_dealt(source), lambda paths: _derived(_held(paths)), workdir.new_folder(spark, "warc-derivatives"))
    return read(made)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the derived records of the whole pages table, two for each page."""
    records = derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    field = F.col("headers").getItem
    body = F.col("block").cast("string")
    return records.select(
        F.when(F.col("type") == "metadata", F.regexp_extract(body, r"source-header: X-Page-Id: (\d+)", 1).cast("long")).alias("page_id"),
        F.col("type").alias("record_type"), "record_id", "uri", field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Source-Payload-Digest").alias("source_digest"), field("WARC-Block-Digest").alias("block_digest"),
        field("Content-Type").alias("content_type"), F.octet_length("block").cast("long").alias("n_bytes"), F.crc32("block").alias("block_crc32"),
    )
