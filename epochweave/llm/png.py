"""Media columns: PNG files in binary columns, and a low-frequency cosine hash.

A payload becomes an 8-bit RGB picture of 64 pixels a row: chunks with CRCs,
rows filtered by Up, zlib. Reading checks the signature and every chunk's
checksum, inflates, and unfilters with numpy (all five filter types). The
feature is the sign pattern of the 8 x 8 lowest cosine coefficients (without
the constant one) of the grey picture, averaged down to 32 x 32, as 16 hex
digits.

Null or empty text: 192 spaces. Any length works; equal texts give equal
values. A null id is kept, repeated rows are stored alike, and an empty table
gives an empty result. Extra columns stay, whatever their type; ``media`` and
media_n_bytes take the place of columns of the same name. A damaged file
raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, PIXEL = 64, 3
ROW = WIDTH * PIXEL
SIDE, LOW = 32, 8
#: Rows of the orthonormal cosine transform, lowest frequencies only.
COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE)) * np.where(np.arange(LOW)[:, None] == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """A PNG whose samples are ``payload`` (a positive multiple of 192 bytes)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.empty((len(rows), ROW + 1), np.uint8)
    filtered[:, 0] = 2
    filtered[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=filtered[1:, 1:])
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(stored: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk, each checked against its CRC."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(stored):
        (size,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if len(body) < size or stored[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + size


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered rows. Runs of None and Up rows go by column sums; the other types row by row."""
    kinds, data = rows[:, 0], rows[:, 1:]
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], np.uint8)
    at = 0
    while at < len(data):
        to = at + 1
        while to < len(data) and kinds[to] == kinds[at] and kinds[at] in (0, 2):
            to += 1
        if kinds[at] == 0:
            out[at:to] = data[at:to]
        elif kinds[at] == 2:
            np.cumsum(data[at:to], axis=0, dtype=np.uint8, out=out[at:to])
            out[at:to] += above
        elif kinds[at] == 1:
            out[at] = np.cumsum(data[at].reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kinds[at] in (3, 4):
            row, up = out[at], above.astype(np.int64)
            for i, x in enumerate(data[at].tolist()):
                left = int(row[i - bpp]) if i >= bpp else 0
                if kinds[at] == 3:
                    guess = (left + int(up[i])) // 2
                else:
                    corner = int(up[i - bpp]) if i >= bpp else 0
                    near = left + int(up[i]) - corner
                    guess = min((left, int(up[i]), corner), key=lambda v: abs(near - v))
                row[i] = (x + guess) & 255
        else:
            raise ValueError("unknown filter")
        above = out[to - 1]
        at = to
    return out


def decode(stored: bytes) -> np.ndarray:
    """Samples (height, width * pixel) of an 8-bit, non-interlaced grey, RGB or RGBA PNG."""
    head, packed = b"", []
    for kind, body in chunks(stored):
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
    bpp = {0: 1, 2: 3, 6: 4}.get(colour, 0)
    if depth != 8 or laced or not bpp:
        raise ValueError("a kind of PNG that is not read here")
    flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(flat) != height * (width * bpp + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(flat.reshape(height, -1), bpp)


def _shrunk(grey: np.ndarray) -> np.ndarray:
    """Means of a 32 x 32 grid; rows repeat where there are fewer."""
    if len(grey) < SIDE:
        grey = grey[np.arange(SIDE) * len(grey) // SIDE]
    cuts = np.arange(SIDE) * len(grey) // SIDE
    tall = np.add.reduceat(grey, cuts, axis=0) / np.diff(np.append(cuts, len(grey)))[:, None]
    return tall.reshape(SIDE, SIDE, -1).mean(axis=2)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: the signs of the lowest cosine coefficients against their median."""
    grey = samples.reshape(len(samples), -1, PIXEL).sum(axis=2, dtype=np.int64)
    low = np.round(COSINES @ _shrunk(grey) @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW if raw else ROW), len(raw)


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with its texts stored as PNG in the binary column ``media`` and their unpadded bytes in ``media_n_bytes``."""
    rest = docs.drop(media, "media_n_bytes")
    schema = StructType([*rest.schema.fields, StructField(media, BinaryType()), StructField("media_n_bytes", LongType())])

    def store(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [payload(x.as_py()) for x in part.column(part.schema.get_field_index(text))]
                cols = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([encode(x) for x, _ in raw], pa.binary()), pa.array([n for _, n in raw], pa.int64())], [*part.schema.names, media, "media_n_bytes"])

    return rest.mapInArrow(store, schema)


def media_features(stored: DataFrame, id_column: str = "doc_id", media: str = "media") -> DataFrame:
    """Digests and cosine hash of stored pictures, from the bytes read back."""

    def read(batches):
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(2)
            rows = []
            for value in batch.column(1):
                stored_bytes = value.as_py()
                samples = decode(stored_bytes)
                body = samples.tobytes()
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(F.col(id_column).cast("long").alias("doc_id"), media, "media_n_bytes").mapInArrow(read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op9(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    return media_features(to_media(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
