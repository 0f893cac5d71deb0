"""WARC derivatives: from response records to linked metadata and plain-text
conversion records.

A response's block is an HTTP message.  Its metadata record holds, as JSON, the
source record's headers, the HTTP status and headers, and the page's title, meta
tags and links; its conversion record holds the page's text.  Both name the
response in WARC-Refers-To, keep its target, date and payload digest, and carry
digests of their own blocks.  Record ids are name-based, so reruns agree.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

VERSION = "WARC/1.1"
#: Date of records made from tables that have none.
DATE = "1970-01-01T00:00:00Z"

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{name}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def write_record(headers: Headers, block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers if k.lower() != "content-length")
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _split_head(data: bytes, at: int = 0, end: int | None = None) -> tuple[str, Headers, int]:
    """First line, headers (continued lines joined) and the length of both with
    the blank line, from ``at`` to that line at ``end``."""
    end = data.find(b"\r\n\r\n", at) if end is None else end
    if end < 0:
        raise ValueError("no end of headers")
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    headers: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            headers.append((k.strip(), v.strip()))
    return first, headers, end + 4 - at


def field(headers: Headers, name: str, default: str | None = None) -> str | None:
    name = name.lower()
    return next((v for k, v in headers if k.lower() == name), default)


def named(headers: Headers) -> dict[str, str | list[str]]:
    """Values by name; a name that repeats has the list of its values, in order."""
    out: dict[str, list[str]] = {}
    for k, v in headers:
        out.setdefault(k, []).append(v)
    return {k: v if len(v) > 1 else v[0] for k, v in out.items()}


#: Compressed bytes that are unpacked at a time.
_STEP = 1 << 18


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members, in parts; ends where the data is damaged, cut or no longer gzip."""
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            some = data[at : at + _STEP]
            try:
                yield member.decompress(some)
            except zlib.error:
                return
            at += len(some) - len(member.unused_data)
        if not member.eof:
            return


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a file, gzip members or plain.

    Ends at the first bytes that are no whole record: junk, a cut or damaged
    file, a head without an end, a Content-Length that is no number.  Heads may
    have any length.  Of a compressed file one record is held at a time.
    """
    parts = _unpacked(data) if data[:2] == b"\x1f\x8b" else iter((data,))
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        del held[:at]
        at = 0
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while len(held) - at < 5 or held.startswith(b"\r\n", at):
            if held.startswith(b"\r\n", at):
                at += 2
            elif not more():
                return
        if not held.startswith(b"WARC/", at):
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                return
        _, headers, n = _split_head(held, at, end)
        length = field(headers, "Content-Length", "0") or "0"
        if not (length.isascii() and length.isdigit()):
            return
        size = int(length)
        while len(held) - at < n + size:
            if not more():
                return
        yield headers, bytes(held[at + n : at + n + size])
        at += n + size


def response_record(url: str, page: str, name: str, date: str = DATE) -> bytes:
    """A response record of one fetched page."""
    payload = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return write_record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id("response", name)),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


# --------------------------------------------------------------------------
# pages

#: One token of markup.  Every alternative ends at the end of the page at the
#: latest, so unclosed markup costs one pass.
_MARKUP = regex.compile(r"<!--(?:.*?)(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", regex.S | regex.I)
_ATTRIBUTE = regex.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CHUNK_SIZE = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title body".split())
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw else {}


def read_page(page: str) -> tuple[str, dict]:
    """(text, {title, metas, links}) of a page.  Blocks end lines; runs of white space become one space."""
    parts: list[str] = []
    title: list[str] | None = None
    info: dict = {"title": None, "metas": [], "links": []}
    at, hidden = 0, 0

    def text(upto: int) -> None:
        if upto > at:
            if title is not None:
                title.append(page[at:upto])
            elif not hidden:
                parts.append(page[at:upto])

    for m in _MARKUP.finditer(page):
        text(m.start())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1] and m[1].lower() == "script" and (src := _attributes(page[m.start() : page.find(">", m.start()) + 1]).get("src")):
                info["links"].append({"path": "SCRIPT@/src", "url": src})
            continue
        closing = bool(m[2])
        if name == "title":
            if closing and title is not None:
                info["title"] = info["title"] or _clean(html.unescape("".join(title)))
            title = None if closing else []
        elif name == "head":
            hidden = 0 if closing else 1
        elif name == "body":
            hidden = 0
        if not closing:
            attributes = _attributes(m[4])
            if name == "meta" and attributes:
                info["metas"].append(attributes)
            elif (link := _LINKS.get(name)) and attributes.get(link):
                info["links"].append({"path": f"{name.upper()}@/{link}", "url": attributes[link]})
        if name in _BLOCKS:
            parts.append("\n")
    text(len(page))
    lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), info


#: Codecs of the language that are no charset of a page.
_NO_CHARSETS = ("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape")


def _decoded(payload: bytes, content_type: str | None) -> str:
    """The payload's text by the charset it names; as UTF-8 if it names none, an unknown one or one that is no text's."""
    found = regex.search(r"charset=[\"']?([\w-]+)", content_type or "", regex.I)
    if found:
        try:
            if codecs.lookup(found[1]).name not in _NO_CHARSETS:
                return payload.decode(found[1], "replace")
        except (LookupError, ValueError):
            pass
    return payload.decode("utf-8", "replace")


def _joined_chunks(body: bytes) -> bytes:
    """The entity of a chunked body; the body itself if it is not chunked after
    all, and the chunks up to the damage if some are broken."""
    out, at = [], 0
    while found := _CHUNK_SIZE.match(body, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[found.end() : found.end() + size])
        at = found.end() + size + 2
    return b"".join(out) or body


def _uncoded(entity: bytes, coding: str) -> bytes:
    """The entity without its gzip, deflate or zstd coding; as it is if it was stored plain."""
    try:
        if coding in ("gzip", "x-gzip"):
            return zlib.decompressobj(31).decompress(entity)
        if coding == "deflate":
            try:
                return zlib.decompressobj(15).decompress(entity)
            except zlib.error:
                return zlib.decompressobj(-15).decompress(entity)
        if coding == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(entity)
    except (zlib.error, zstandard.ZstdError):
        pass
    return entity


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """Metadata and conversion records of a response record; none of any other record."""
    if field(headers, "WARC-Type") != "response":
        return []
    source, target, date = field(headers, "WARC-Record-ID", ""), field(headers, "WARC-Target-URI", ""), field(headers, "WARC-Date", DATE)
    try:
        status, http, n = _split_head(block)
        payload = block[n:]
    except ValueError:
        status, http, payload = "", [], block
    if "chunked" in (field(http, "Transfer-Encoding") or "").lower():
        payload = _joined_chunks(payload)
    payload_digest = field(headers, "WARC-Payload-Digest") or digest(payload)
    page = _uncoded(payload, (field(http, "Content-Encoding") or "").strip().lower())
    text, info = read_page(_decoded(page, field(http, "Content-Type")))
    about = {
        "Envelope": {
            "WARC-Header-Metadata": named(headers),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {"Response-Message": status, "Headers": named(http), "Entity-Length": len(payload), "Entity-Digest": payload_digest, "HTML-Metadata": {"Title": info["title"], "Metas": info["metas"], "Links": info["links"]}}
            },
        }
    }
    out = []
    for kind, content_type, body in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain", text.encode())):
        out.append(
            (
                [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", record_id(kind, source)),
                    ("WARC-Refers-To", source),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", target),
                    ("WARC-Refers-To-Payload-Digest", payload_digest),
                    ("WARC-Block-Digest", digest(body)),
                    ("Content-Type", content_type),
                ],
                body,
            )
        )
    return out


# --------------------------------------------------------------------------
# tables


def response_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, record binary): a response record for every page.  Null html is
    an empty page, a null url an empty target; ids are named by page id and url,
    so rows that repeat both share a record id."""

    def run(batches):
        for batch in batches:
            rows = zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html")))
            made = [response_record(u or "", h or "", f"{p}:{u or ''}", date) for p, u, h in rows]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id null, record binary) of the records of WARC files (.warc or
    .warc.gz) on any Spark file system.  A file is one task's work, below 2 GB
    as stored; its records leave the task in batches of ``_BATCH`` bytes."""

    def batch_of(records):
        return pa.RecordBatch.from_arrays([pa.array([None] * len(records), pa.int64()), pa.array(records, pa.binary())], names=["page_id", "record"])

    def run(batches):
        for batch in batches:
            for content in column(batch, "content"):
                some, size = [], 0
                for headers, block in read_records(content.as_py() or b""):
                    some.append(write_record(headers, block))
                    size += len(some[-1])
                    if size >= _BATCH:
                        yield batch_of(some)
                        some, size = [], 0
                yield batch_of(some)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, record binary")


#: Bytes of records that a reading task hands on at a time.
_BATCH = 32 << 20

DERIVED = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, source_headers string, block string, record binary"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for every response record in (page_id, record): its metadata and
    its conversion record, as columns and as the serialised ``record``.  Null,
    empty or broken records and records of other types give no rows.  Rows are
    independent of each other: no shuffle."""
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for page, raw in zip(column(batch, "page_id").to_pylist(), column(batch, "record")):
                for headers, block in read_records(raw.as_py() or b""):
                    source = json.dumps(named(headers), ensure_ascii=False, sort_keys=True)
                    for made, body in derive(headers, block):
                        got = dict(made)
                        rows.append(
                            (page, *(got[k] for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Refers-To-Payload-Digest", "WARC-Block-Digest")), len(body), source, body.decode(), write_record(made, body))
                        )
            kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.string(), pa.binary()]
            cells = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

    return records.mapInArrow(run, DERIVED)
