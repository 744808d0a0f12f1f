"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Pages become response records (HTTP head and body). From each response come a
metadata record (title, links, language and the source record's headers) and a
conversion record with the page's text; both name the response in
WARC-Refers-To, repeat its target, date and payload digest, and carry block
digests of their own. Record ids derive from the contents, so reruns agree.

Responses of other writers are read by their HTTP heads: chunked transfer,
gzip, deflate and zstd contents, and the character set that the head or the
page names. A body in an encoding that is not known here has metadata and an
empty text.

Nulls: a null URL or body is empty; a null page id is kept; a null or empty
response has no derivatives. Repeated rows give equal records with equal ids. Empty tables give empty results. Pages of any
length and form are read in linear time; a worker holds one at a time. Only
page_id (a whole number), url and html are read, so other columns cannot
clash. A record that breaks the format, or fails its digest, raises ValueError
when it is read.
"""

from __future__ import annotations

import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
#: No pattern reads on beyond the next tag that begins, unless it takes what it has read: time is linear in the page.
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|template|noscript|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|blockquote|pre|body)\b)[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w:.-]+)", re.I)
#: Bytes of a page in which it may name its character set.
NAMED_WITHIN = 1024
#: Single spaces, most of a text, stay as they are.
_BLANKS = re.compile(r"[ \t\r\f\v]{2,}|[\t\r\f\v]")
_LINES = re.compile(r" ?\n[ \n]*")


#: Any ten bits in base 32.
_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(data: bytes) -> str:
    """The SHA-1 of a block, in base 32: 160 bits are sixteen pairs of digits."""
    bits = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([_PAIRS[bits >> at & 1023] for at in range(150, -1, -10)])


def record_id(kind: str, *parts: bytes) -> str:
    raw = hashlib.sha256(kind.encode() + b"\0" + b"\0".join(hashlib.sha256(p).digest() for p in parts)).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=4)}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **headers, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    clean = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{clean}\r\n".encode() + block + b"\r\n\r\n"


def named(line: str) -> tuple[str, str]:
    """Name and value of a header line."""
    name, _, value = line.partition(":")
    return name.strip(), value.strip()


def unchunked(body: bytes) -> bytes:
    """A body that was sent in chunks; what follows a broken chunk is left out."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at : max(end, at)].split(b";")[0], 16)
        except ValueError:
            break
        if size == 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def content(http: dict[str, str], body: bytes) -> bytes | None:
    """The body without its content encodings, or None if one is not known or broken."""
    for name in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] and body[0] & 15 == 8 else -15).decompress(body)
            elif name == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif name != "identity":
                return None
        except (zlib.error, zstandard.ZstdError):
            return None
    return body


def decoded(http: dict[str, str], body: bytes) -> str:
    """A page as text, by the character set of the HTTP head, or else the one that the page names, or else UTF-8."""
    for place in (http.get("content-type", "").encode("latin-1", "replace"), body[:NAMED_WITHIN]):
        found = _CHARSET.search(place)
        if found:
            try:
                return body.decode(found.group(1).decode(), "replace")
            except LookupError:
                continue
    return body.decode("utf-8", "replace")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, digests checked."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = dict(named(x) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record ends too early")
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != digest(block):
            raise ValueError("a block fails its digest")
        yield headers, block
        at = end + 8 + size


def response(url: str, body: bytes) -> bytes:
    """A response record of a page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = {"WARC-Record-ID": record_id("response", url.encode(), body), "WARC-Date": DATE, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body)}
    return record("response", headers, block)


def title_of(page: str) -> str:
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return " ".join(entities.unescape(page[begin.end() : end.start()]).split()) if end else ""


def plain_text(page: str) -> str:
    """Text of an HTML page: no scripts, styles or head; block elements end lines."""
    text = entities.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page))))
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def derivatives(stored: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record."""
    headers, block = next(parse(stored), ({}, b""))
    if headers.get("WARC-Type") != "response":
        raise ValueError("not a response")
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [named(x) for x in head.decode("latin-1").split("\r\n")[1:] if ":" in x]
    http = {name.lower(): value for name, value in lines}
    payload = unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
    given = headers.get("WARC-Payload-Digest")
    if given is not None and given.startswith("sha1:") and given != digest(body) and (payload is body or given != digest(payload)):
        raise ValueError("a payload fails its digest")
    raw = content(http, payload)
    page = decoded(http, raw) if raw is not None else ""
    lang = _LANG.search(page)
    links = [entities.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
    fields = [("title", title_of(page)), ("languages-html", lang.group(1) if lang else ""), ("n-outlinks", str(len(links)))]
    fields += [("outlink", " ".join(x.split())) for x in links]
    fields += [(f"http-{name.lower()}", value) for name, value in lines]
    source = headers["WARC-Record-ID"]
    shared = {"WARC-Date": headers["WARC-Date"], "WARC-Target-URI": headers.get("WARC-Target-URI", ""), "WARC-Refers-To": source, "WARC-Payload-Digest": given or digest(body)}
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = plain_text(page).encode()
    first = record("metadata", {"WARC-Record-ID": record_id("metadata", source.encode(), meta), **shared, "Content-Type": "application/warc-fields"}, meta)
    second = record("conversion", {"WARC-Record-ID": record_id("conversion", source.encode(), text), **shared, "Content-Type": "text/plain"}, text)
    return first, second


def to_responses(pages: DataFrame) -> DataFrame:
    """(page_id, response): a gzipped response record of each page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [gzip.compress(response(u.as_py() or "", (h.as_py() or "").encode()), 1, mtime=0) for u, h in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["page_id", "response"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, response binary")


def derive(responses: DataFrame) -> DataFrame:
    """(page_id, metadata, conversion): the gzipped derivatives of each gzipped response; each is a whole member of a .warc.gz file. Null or empty responses have nulls."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [derivatives(gzip.decompress(r)) if r else None for r in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x and gzip.compress(x[i], 1, mtime=0) for x in both], pa.binary()) for i in (0, 1))], ["page_id", "metadata", "conversion"])

    return responses.select("page_id", "response").mapInArrow(run, "page_id bigint, metadata binary, conversion binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_id, type, refers_to, target_uri, payload_digest, block) of the records of .warc and .warc.gz files."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows = [(name, h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest"), b) for h, b in parse(raw)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], ["file", "record_id", "type", "refers_to", "target_uri", "payload_digest", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record_id string, type string, refers_to string, target_uri string, payload_digest string, block binary")


def op5(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, meta, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                (mh, mb), (ch, cb) = (next(parse(gzip.decompress(x.as_py()))) for x in (meta, text))
                rows.append((page_id, mh["WARC-Refers-To"], mh["WARC-Record-ID"], ch["WARC-Record-ID"], ch["WARC-Refers-To"] == mh["WARC-Refers-To"], ch["WARC-Target-URI"], ch["WARC-Payload-Digest"], mh["WARC-Block-Digest"], ch["WARC-Block-Digest"], len(cb), hashlib.sha256(mb).hexdigest(), hashlib.sha256(cb).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], NAMES)

    return derive(to_responses(table(spark, sf_dir, "pages"))).mapInArrow(run, OP5)


OP5 = "page_id bigint, response_id string, metadata_id string, conversion_id string, linked boolean, target_uri string, payload_digest string, metadata_digest string, conversion_digest string, text_bytes bigint, metadata_sha256 string, text_sha256 string"
NAMES = [x.split()[0] for x in OP5.split(", ")]
TYPES = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in OP5.split(", ")]
