import gzip
import zlib

import pytest
import zstandard

from epochweave.llm import warc

PAGE = "<html><head><title>Grüße</title></head><body><p>Schöne Grüße</p><a href=x.html>eins</a> <a href='y z'>zwei</a></body></html>"


def stored(body: bytes, head: str, payload: bytes | None = None) -> bytes:
    """A response as another writer has it."""
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode("latin-1") + body
    return warc.record("response", {"WARC-Record-ID": "<urn:x>", "WARC-Date": warc.DATE, "WARC-Target-URI": "http://x", "WARC-Payload-Digest": warc.digest(body if payload is None else payload)}, block)


def chunked(raw: bytes) -> bytes:
    cut = [raw[i : i + 50] for i in range(0, len(raw), 50)]
    return b"".join(f"{len(c):x};a=b\r\n".encode() + c + b"\r\n" for c in cut) + b"0\r\n\r\n"


RAW = PAGE.encode("latin-1")
UTF = PAGE.encode()
WITH_META = PAGE.replace("<head>", '<head><meta charset="iso-8859-1">').encode("latin-1")


@pytest.mark.parametrize(
    ("body", "head"),
    [
        (RAW, "Content-Type: text/html; charset=ISO-8859-1"),
        (WITH_META, "Content-Type: text/html"),
        (WITH_META, "Content-Type: text/html; charset=no-such-set"),
        (UTF, "Content-Type:text/html"),
        (UTF, "X: y"),
        (gzip.compress(UTF), "Content-Encoding: gzip"),
        (zlib.compress(UTF), "content-encoding: deflate"),
        (zlib.compress(UTF)[2:-4], "Content-Encoding: deflate"),
        (zstandard.ZstdCompressor().compress(UTF), "Content-Encoding: zstd"),
        (chunked(UTF), "Transfer-Encoding: chunked"),
        (chunked(gzip.compress(UTF)), "Transfer-Encoding:chunked\r\nContent-Encoding: gzip"),
    ],
)
def test_bodies_of_other_writers(body, head):
    meta, text = (next(warc.parse(x)) for x in warc.derivatives(stored(body, head)))
    assert text[1].decode() == "Schöne Grüße\neins zwei" and text[0]["WARC-Refers-To"] == "<urn:x>"
    lines = meta[1].decode().split("\r\n")
    assert "title: Grüße" in lines and "outlink: x.html" in lines and "outlink: y z" in lines and any(x.startswith("http-") for x in lines)


def test_bodies_that_cannot_be_read():
    """An encoding that is not known, or broken, gives metadata and an empty text; a wrong digest is an error; a digest of the body without its chunks is right."""
    for body, head in ((b"??", "Content-Encoding: br"), (b"no gzip", "Content-Encoding: gzip"), (b"", "X: y")):
        meta, text = (next(warc.parse(x)) for x in warc.derivatives(stored(body, head)))
        assert text[1] == b"" and b"n-outlinks: 0" in meta[1]
    assert warc.derivatives(stored(chunked(UTF), "Transfer-Encoding: chunked", payload=UTF))
    with pytest.raises(ValueError, match="digest"):
        warc.derivatives(stored(UTF, "X: y", payload=b"other"))
    for other in (b"", warc.record("request", {"WARC-Record-ID": "<urn:x>"}, b"x")):
        with pytest.raises(ValueError, match="not a response"):
            warc.derivatives(other)
    assert warc.unchunked(b"5\r\nhello\r\nzz") == b"hello"


def test_missing_responses(spark):
    given = [(1, None), (2, b""), (3, gzip.compress(stored(UTF, "X: y"))), (None, gzip.compress(stored(RAW, "Content-Type: a; charset=latin-1")))]
    got = {r["page_id"]: r for r in warc.derive(spark.createDataFrame(given, "page_id bigint, response binary")).collect()}
    assert len(got) == 4 and got[1]["metadata"] is got[2]["conversion"] is None
    for i in (3, None):
        assert next(warc.parse(gzip.decompress(got[i]["conversion"])))[1].decode().startswith("Schöne Grüße")


def test_digests_and_blanks_are_the_plain_ones():
    import base64
    import hashlib
    import re

    for data in (b"", b"a", b"page" * 1000, bytes(range(256))):
        assert warc.digest(data) == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    for text in ("a b", "a  b", "a\tb", " \t a \r\n  b\f\v", "", " ", "a \xa0 b"):
        assert warc._BLANKS.sub(" ", text) == re.sub(r"[ \t\r\f\v]+", " ", text)
