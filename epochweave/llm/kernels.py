"""Vectorised kernels over Arrow text columns: words, hashes of words and of their spans, window minima.

Words are hashed by tables of random values, one for each place and byte, so
no arithmetic of their bytes makes two of them equal. Spans of such values, or
of bytes, are polynomials modulo 2**64: fit for spans of up to some hundred
symbols, as shingles and windows are, and not for longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A word is a run of anything but space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
#: Bytes of a word that have tables of their own; longer words are hashed one by one.
TABLED = 48
_TABLES = np.random.default_rng(20240515).integers(0, 1 << 64, TABLED * 256, dtype=np.uint64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, U64(base))
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit hangs on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; ``spans`` turns them into hashes of any range."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [starts, ends): equal contents, equal values, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def sliding(sums: np.ndarray, width: int) -> np.ndarray:
    """``spans`` of all windows of ``width`` neighbours."""
    m = len(sums) - width
    return mix((sums[width:] - sums[:m]) * powers(len(sums))[1][:m])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of ``batch`` of about ``most`` text bytes (a longer text stands alone) with the text bytes and row offsets; null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = pc.fill_null(text, "")
    text = text.cast(pa.large_binary()) if not pa.types.is_large_binary(text.type) else text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(text))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offsets of each row's words; no word crosses a row, or holds a byte that is marked in ``between``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = between[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = space[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] = True
    starts = np.flatnonzero(~space & edge[:n])
    edge[0:n] = False
    edge[: n - 1] = space[1:]
    edge[inner - 1] = True
    edge[n - 1] = True
    ends = np.flatnonzero(~space & edge[:n]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals become small letters; every other byte stays."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by its bytes and their places; words do not overlap and stand in order."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    known = np.minimum(size, TABLED + 1)
    order = np.argsort(known.astype(np.uint8), kind="stable")
    begin, out = starts[order], np.zeros(len(size), U64)
    # By length, the words that have a byte at a place are the last ones.
    for place, a in enumerate(np.searchsorted(known[order], np.arange(1, min(int(size.max()), TABLED) + 1)).tolist()):
        out[a:] += _TABLES[data[begin[a:] + place].astype(np.int64) + (place << 8)]
    sums = np.empty_like(out)
    sums[order] = out
    out = mix(sums + size.astype(U64))
    long = size > TABLED
    if long.any():
        raw = memoryview(np.ascontiguousarray(data))
        some = np.flatnonzero(long)
        out[some] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``width`` neighbours.

    Values are compared by their high 32 bits; positions take the low ones, so
    a window's answer hangs on its own values alone.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    digits = U64(32)
    least = values >> digits << digits | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    return (least & ((U64(1) << digits) - U64(1))).astype(np.int64)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
