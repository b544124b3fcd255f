"""WARC derivative builder: metadata and plain-text conversion records from response records.

Each response gives two records that refer to it: `metadata` (application/warc-fields: what the source said of itself)
and `conversion` (text/plain: the visible text of its HTML). Both carry WARC-Refers-To, WARC-Refers-To-Target-URI and
WARC-Refers-To-Date, a block digest of their own, and the digest of the source's payload; the metadata record keeps the source's HTTP headers.
Identifiers are derived from the response's identifier and the record type, so a rerun or a retried task makes the same ones.

A page is read by one pass from `<` to `<` (scanned()), so broken markup costs no more than sound markup: a `<` that no `>` follows is text,
an element without visible text whose end is missing hides the rest. Payloads are unpacked (chunks, gzip, deflate) and read in the charset
that the HTTP head names; without one, or where it is unknown, as UTF-8 with replacement characters. What cannot be unpacked is read as it is.

Results: a null payload is empty and gives an empty text; a null target or date leaves out its headers; a null http head has no
fields. A null record_id leaves out WARC-Refers-To, and the derived identifiers come from the target and the payload's digest. Every
row gives its two records, repeated rows too (with the same identifiers). An empty table gives no rows; other columns of the responses
play no part, whatever their names. Long payloads are read whole. A truncated archive gives the records before the cut.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Elements without visible text, elements that end a line.
HIDDEN = frozenset(b"script style noscript template head".split())
BREAKS = frozenset(b"p div article section header footer nav aside main ul ol li dl dt dd table tr h1 h2 h3 h4 h5 h6 pre blockquote form figure hr br".split())
_NAME = re.compile(rb"/?([a-z][a-z0-9-]*)")
_HREF = re.compile(rb"""[\s"']href\s*=\s*["']?[^"'\s>]""")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n\s*")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {source}'.encode()).digest()[:16], version=5)}>"


def scanned(page: str) -> tuple[str, str, int]:
    """Visible text, title, and number of links (tags `a` with `href` that are not hidden) of a page, in one pass."""
    raw = page.encode("utf-8", "replace")
    low = raw.lower()
    out, title, links, at, close = [], None, 0, 0, -1
    while (start := low.find(b"<", at)) >= 0:
        out.append(raw[at:start])
        if low.startswith(b"<!--", start):
            end = low.find(b"-->", start + 4)
            out.append(b" ")
            at = end + 3 if end >= 0 else len(raw)
            continue
        if close < start:  # the next ">" is looked for once, however many "<" come before it
            close = low.find(b">", start)
            close = len(raw) if close < 0 else close
        name = _NAME.match(low, start + 1, min(close, start + 40))
        if close == len(raw) or not (name or low[start + 1 : start + 2] in (b"!", b"?", b"/")):
            out.append(b"<")
            at = start + 1
            continue
        at, word = close + 1, name[1] if name else b""
        opens = bool(name) and low[start + 1 : start + 2] != b"/"
        if word == b"a" and opens and _HREF.search(low, start, close + 1):
            links += 1
        elif word in BREAKS:
            out.append(b"\n")
        elif word == b"title" and opens and title is None:
            end = low.find(b"</title", at)
            title = raw[at : end if end >= 0 else len(raw)]
        elif word in HIDDEN and opens:
            end = ended(low, word, at)
            if word == b"head" and title is None and (t := low.find(b"<title", at, end)) >= 0 and (shut := low.find(b">", t, end)) >= 0:
                stop = low.find(b"</title", shut, end)
                title = raw[shut + 1 : stop if stop >= 0 else end]
            shut = low.find(b">", end)
            at = shut + 1 if shut >= 0 else len(raw)
            out.append(b" ")
    out.append(raw[at:])
    text = unescaped(b"".join(out))
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip(), " ".join(unescaped(title or b"").split()), links


def ended(low: bytes, word: bytes, at: int) -> int:
    """Where the end tag of an element starts, or the end of the page."""
    tag = b"</" + word
    while (end := low.find(tag, at)) >= 0:
        if low[end + len(tag) : end + len(tag) + 1] in (b">", b" ", b"\t", b"\n", b"\r", b"\f", b"/"):
            return end
        at = end + len(tag)
    return len(low)


def unescaped(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return html.unescape(text) if "&" in text else text


def plain_text(page: str) -> str:
    return scanned(page)[0]


def fields(head: str | None) -> list[tuple[str, str]]:
    lines = re.sub(r"\r?\n[ \t]+", " ", head or "").splitlines()
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if v and not k.startswith("HTTP/")]


def unpacked(head: str | None, body: bytes) -> bytes:
    """The body without the transfer and content encodings that the HTTP head names; as it is where they do not hold."""
    told = {k.lower(): v.lower() for k, v in fields(head)}
    try:
        if "chunked" in told.get("transfer-encoding", ""):
            parts, at = [], 0
            while n := int(body[at : (line := body.index(b"\r\n", at))].split(b";")[0], 16):
                parts.append(body[line + 2 : line + 2 + n])
                at = line + n + 4
            body = b"".join(parts)
        if (packed := told.get("content-encoding")) in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif packed == "deflate":
            body = zlib.decompress(body) if body[:1] == b"x" else zlib.decompress(body, -15)
    except (ValueError, OSError, EOFError, zlib.error):
        pass
    return body


def charset(head: str | None) -> str:
    """The charset that the HTTP head names, if it is known and of text; else UTF-8."""
    found = _CHARSET.search(dict((k.lower(), v) for k, v in fields(head)).get("content-type", ""))
    try:
        known = codecs.lookup(found[1]) if found else None
    except LookupError:
        known = None
    return known.name if known is not None and known._is_text_encoding else "utf-8"


def record(kind: str, source: str | None, target: str | None, date: str | None, content_type: str, block: bytes, source_digest: str) -> dict:
    own = derived_id(source if source is not None else f"{target or ''} {source_digest}", kind)
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Source-Payload-Digest", source_digest), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"warc_type": kind, "record_id": own, "refers_to": source, "target_uri": target, "date": date, "content_type": content_type, "headers": "".join(f"{k}: {v}\r\n" for k, v in head if v is not None), "block_digest": digest(block), "source_digest": source_digest, "block": block}


def build(source: str | None, target: str | None, date: str | None, head: str | None, payload: bytes) -> list[dict]:
    page = unpacked(head, payload).decode(charset(head), "replace")
    told, (text, title, links) = digest(payload), scanned(page)
    plain = text.encode("utf-8", "replace")
    notes = [("source-record", source or ""), ("source-payload-digest", told), ("source-length", str(len(payload))), ("title", title), ("outlinks", str(links)), *((f"source-header-{k.lower()}", v) for k, v in fields(head)), ("conversion-digest", digest(plain))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in notes).encode("utf-8", "replace")
    return [record("metadata", source, target, date, "application/warc-fields", meta, told), record("conversion", source, target, date, "text/plain; charset=utf-8", plain, told)]


def derive(responses: DataFrame, *, record_id: str = "record_id", target: str = "target_uri", date: str = "date", head: str = "http_headers", payload: str = "payload", columns: list[str] | None = None) -> DataFrame:
    """Two rows for each response: warc_type, record_id, refers_to, target_uri, date, content_type, headers, block_digest, source_digest, block."""
    kinds = {"warc_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "date": "string", "content_type": "string", "headers": "string", "block_digest": "string", "source_digest": "string", "n_bytes": "long", "block": "binary"}
    kept = list(columns or kinds)

    def make():
        def step(batch):
            out: dict[str, list] = {c: [] for c in kept}
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for r in build(*row[:4], row[4] or b""):
                    r["n_bytes"] = len(r["block"])
                    for c in kept:
                        out[c].append(r[c])
            yield out

        return step

    text = [F.col(c).cast("string") for c in (record_id, target, date, head)]
    return map_batches(responses.select(*[c.alias(f"c{i}") for i, c in enumerate(text)], F.col(payload).cast("binary").alias("p")), ", ".join(f"{c} {kinds[c]}" for c in kept), make)


def serialise(row) -> bytes:
    """A record of derive() as bytes of a WARC file."""
    return b"WARC/1.1\r\n" + row["headers"].encode() + b"\r\n" + bytes(row["block"]) + b"\r\n\r\n"


def members(raw: bytes) -> Iterator[bytes]:
    """The parts of a gzip file one by one (a part is a record, as archives are written), or a plain file as it is."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while raw[at : at + 2] == b"\x1f\x8b":
        part, out = zlib.decompressobj(31), []
        try:
            while not part.eof and at < len(raw):  # in blocks, for what a member leaves unused is copied
                out.append(part.decompress(raw[at : at + 65536]))
                at += 65536
        except zlib.error:
            return
        yield b"".join(out)
        if not part.eof:
            return
        at = min(at, len(raw)) - len(part.unused_data)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (headers by lower-case name, block) of a WARC file, which may be gzipped record by record. A record that is cut off ends it."""
    for part in members(raw):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                return
            head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in part[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
            size = int(head["content-length"]) if head.get("content-length", "").isdecimal() else 0
            if end + 4 + size > len(part):
                return
            yield head, part[end + 4 : end + 4 + size]
            at = end + 4 + size


def read_responses(spark, path: str) -> DataFrame:
    """Response records of WARC files, as derive() takes them; a file is one task's work, as gzip cannot be split."""

    def make():
        def step(batch):
            out: dict[str, list] = {c: [] for c in ("record_id", "target_uri", "date", "http_headers", "payload")}
            for raw in batch.column(0).to_pylist():
                for head, block in parse(raw):
                    if head.get("warc-type") == "response":
                        top, _, body = block.partition(b"\r\n\r\n")
                        for c, x in zip(out, (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), top.decode("latin-1"), body), strict=True):
                            out[c].append(x)
            yield out

        return step

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), "record_id string, target_uri string, date string, http_headers string, payload binary", make)


def op2_derivatives(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    uid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    responses = pages.select(uid.alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n").alias("http_headers"), F.col("html").cast("binary").alias("payload"))
    return derive(responses, columns=["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "headers", "n_bytes", "block_digest", "source_digest", "block"])
