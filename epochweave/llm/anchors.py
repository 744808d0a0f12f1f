"""Content-chosen anchors: the meeting points of repeated windows.

Each window of ``window`` symbols (words or bytes) has one anchor, the
leftmost least hash among its ``seed``-symbol grams. The windows of one anchor
stand side by side; what they cover is the anchor's piece of the document.
Equal windows have equal anchors at equal places, so whatever repeats meets
under its anchor's key, in the pieces of that key.

Documents are dealt to homes, by id and text, and each home sums up its pieces
first: a piece that a third of all documents share is one row of each home.
By key, rows of all homes tell which keys hold more than one occurrence; their
distinct pieces are fetched, once each, and make up the blocks in which an
operator finds its repeats. Its verdicts go back to every home that has the
piece. A key of more than ``CROWD`` distinct pieces, as at the edges of a
passage that very many documents share, is not gathered: each window of its
pieces becomes a piece of its own under its own hash.

Rows travel in blobs: per group and bucket one row with packed columns, so
that millions of pieces are some thousands of rows to Spark. The number of
buckets follows the bytes of the texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.llm import kernels as k

_CODEC = "zstd"
NULL_ID = np.iinfo(np.int64).max
WIDTH = 7
BLOB = "bucket int, n int, " + ", ".join(f"c{i} binary" for i in range(WIDTH))
BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((f"c{i}", pa.binary()) for i in range(WIDTH))])
#: Bytes of text that a bucket holds at most on average; distinct pieces that a key gathers; pieces that are searched at once.
BUCKET, CROWD, AT_ONCE = 128 << 20, 4096, 4096


@dataclass(frozen=True)
class Rule:
    """What repeats: windows of ``window`` symbols, met under keys of ``seed`` symbols."""

    window: int
    seed: int
    unit: str  # "word" or "byte"
    ordered: bool  # only what stands in a smaller document counts

    @property
    def left(self) -> int:
        return self.window - self.seed


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame) -> int:
    """Buckets of at most some ``BUCKET`` bytes of text, and no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(buckets(docs.sparkSession), -(-size // BUCKET))


def squeeze(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values)
    return len(raw).to_bytes(4, "little") + raw.dtype.str.encode().ljust(4) + (raw.nbytes).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec=_CODEC, asbytes=True)


def expand(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[8:16], "little")
    return np.frombuffer(pa.decompress(blob[16:], decompressed_size=size, codec=_CODEC, asbytes=True) if size else b"", np.dtype(blob[4:8].decode().strip()))


def narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def widen(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(values) // width, 8), np.uint8)
    out[:, :width] = values.reshape(-1, width)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    return squeeze(np.diff(ids, prepend=np.int64(0)))


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob))


def deal(group: np.ndarray, columns: list[tuple]) -> Iterable[pa.RecordBatch]:
    """Blob rows of ``columns``, (values, packer) each, one per value of ``group``."""
    if not len(group):
        return
    group = group.astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
    rows: list[list] = [[] for _ in range(2 + WIDTH)]
    for a, b in zip(cuts, [*cuts[1:], len(group)], strict=True):
        mine = order[a:b]
        rows[0].append(int(group[mine[0]]))
        rows[1].append(len(mine))
        for i in range(WIDTH):
            rows[2 + i].append(columns[i][1](columns[i][0][mine]) if i < len(columns) else None)
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[2:])], BLOB_SCHEMA.names)


def gather(table: pa.Table, unpackers: list) -> list[np.ndarray]:
    """The columns of all blobs of a group, one after the other."""
    return [np.concatenate([f(x.as_py()) for x in table.column(f"c{i}")]) if table.num_rows else f(squeeze(np.zeros(0, np.int64))) for i, f in enumerate(unpackers)]


def row_ids(part: pa.RecordBatch) -> np.ndarray:
    ids = part.column(part.schema.get_field_index("doc_id"))
    return np.asarray(ids.fill_null(int(NULL_ID)), dtype=np.int64)


def symbols(rule: Rule, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the symbols of some rows and the rows' offsets among them."""
    if rule.unit == "byte":
        return k.byte_values(data), offsets
    starts, ends, bounds = k.words(data, offsets)
    return k.word_hashes(data, starts, ends), bounds


KEY, CONTEXT = 5, 6


@dataclass
class Pieces:
    """Pieces of some rows: row, place among the row's symbols, anchor within the piece, size, key and content hash."""

    row: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    size: np.ndarray
    key: np.ndarray
    context: np.ndarray

    @property
    def code(self) -> np.ndarray:
        return code_of(self.key, self.context)


def code_of(keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """64-bit names of pieces, from the bytes of keys and contexts that travel."""
    return k.mix(_low(keys, KEY) * k.U64(0x9E3779B97F4A7C15) + k.mix(_low(contexts, CONTEXT)))


def _low(values: np.ndarray, width: int) -> np.ndarray:
    return values & k.U64((1 << 8 * width) - 1)


def find(rule: Rule, values: np.ndarray, bounds: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """The pieces of some rows, in their order, and the prefix hashes of all symbols."""
    sums = k.prefix(values)
    n = len(values) - rule.window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)), sums
    grams = k.sliding(sums, rule.seed)
    least = k.window_minima(grams, rule.left + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    inside = np.flatnonzero(np.arange(n) + rule.window <= bounds[1:][row])
    row, least = row[inside], least[inside]
    cut = np.ones(len(inside), bool)
    cut[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    low, high = inside[first], inside[np.append(first[1:], len(inside)) - 1] + rule.window
    row, at = row[first], least[first]
    contexts = k.mix(k.spans(sums, low, high) + ((high - low) * 65536 + (at - low)).astype(np.uint64))
    return Pieces(row, low - bounds[row], at - low, high - low, grams[at], contexts), sums


def windows_of(rule: Rule, pieces: Pieces, mine: np.ndarray, sums: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Pieces]:
    """Every window of the pieces ``mine`` as a piece under its own hash, and the piece it is of."""
    count = pieces.size[mine] - rule.window + 1
    of = np.repeat(mine, count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = pieces.start[of] + step
    low = bounds[pieces.row[of]] + start
    hashes = k.spans(sums, low, low + rule.window)
    return of, Pieces(pieces.row[of], start, pieces.anchor[of] - step, np.full(len(of), rule.window), k.mix(hashes + k.U64(1)), k.mix(hashes + k.U64(2)))


DOC = "doc_id bigint, text string, bucket int"


def by_home(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, bucket): each document with its home, by its id and its text."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in k.slices(batch, "text", 8 << 20):
                raw = memoryview(np.ascontiguousarray(data))
                tags = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
                where = k.mix(row_ids(part).astype(np.uint64) * k.U64(0x9E3779B97F4A7C15) + tags) % k.U64(n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(where.astype(np.int32))], ["doc_id", "text", "bucket"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DOC)


def each_slice(table: pa.Table, most: int = 1 << 20):
    """``kernels.slices`` over all rows of a table."""
    for batch in table.to_batches():
        yield from k.slices(batch, "text", most)


def each_found(rule: Rule, table: pa.Table):
    """(rows, text bytes, offsets, ids, symbols, their offsets, pieces, prefix hashes) of slices of documents."""
    for part, data, offsets in each_slice(table):
        values, bounds = symbols(rule, data, offsets)
        yield part, data, offsets, row_ids(part), values, bounds, *find(rule, values, bounds)


def summed(codes: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of equal codes: the index of one, that of the least id, the least id, and whether they are one (1) or more (2)."""
    order = np.lexsort((ids, codes))
    first = np.flatnonzero(np.diff(codes[order], prepend=~codes[order][:1]) != 0)
    total = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return first, order[first], ids[order[first]], np.minimum(total, 2).astype(np.uint8)


five, six = (lambda x: squeeze(narrow(x, KEY))), (lambda x: squeeze(narrow(x, CONTEXT)))
of_five, of_six = (lambda x: widen(expand(x), KEY)), (lambda x: widen(expand(x), CONTEXT))


def by_key(keys: np.ndarray, n: int) -> np.ndarray:
    return _low(keys, KEY) % k.U64(n)


def scan(rule: Rule, homed: DataFrame, n: int) -> DataFrame:
    """Blobs by key: keys, contexts, least ids, times (1, or 2 for more), home of each home's distinct pieces."""

    def run(key, table):
        found: list[list] = [[] for _ in range(3)]
        for *_, ids, _, _, pieces, _ in each_found(rule, table):
            for out, x in zip(found, (_low(pieces.key, KEY), pieces.context, ids[pieces.row]), strict=True):
                out.append(x)
        keys, contexts, ids = map(np.concatenate, found)
        _, one, least, times = summed(code_of(keys, contexts), ids, np.ones(len(ids), np.uint8))
        here = np.full(len(one), key[0].as_py(), np.int32)
        return pa.Table.from_batches(list(deal(by_key(keys[one], n), [(keys[one], five), (contexts[one], six), (least, pack_ids), (times, squeeze), (here, squeeze)])), BLOB_SCHEMA)

    return homed.groupBy("bucket").applyInArrow(run, BLOB)


FETCH, SPLIT = 0, 1


def ask(found: DataFrame) -> DataFrame:
    """Blobs by home: codes and kinds. ``FETCH``: this home sends the piece. ``SPLIT``: every home sends its windows.

    Keys with one occurrence are left out: nothing there repeats.
    """

    def run(key, table):
        keys, contexts, _, times, homes = gather(table, [of_five, of_six, unpack_ids, expand, expand])
        order = np.lexsort((homes, contexts, keys))
        keys, contexts, times, homes = keys[order], contexts[order], times[order], homes[order]
        new_key = np.diff(keys, prepend=~keys[:1]) != 0
        new = new_key | (np.diff(contexts, prepend=~contexts[:1]) != 0)
        group = np.cumsum(new_key) - 1
        again = (np.bincount(group, weights=times, minlength=1) > 1)[group]
        crowded = (np.bincount(group, weights=new, minlength=1) > CROWD)[group]
        mine = np.flatnonzero(crowded | (new & again))
        kinds = np.where(crowded, SPLIT, FETCH).astype(np.uint8)[mine]
        return pa.Table.from_batches(list(deal(homes[mine], [(code_of(keys[mine], contexts[mine]), squeeze), (kinds, squeeze)])), BLOB_SCHEMA)

    return found.groupBy("bucket").applyInArrow(run, BLOB)


def _wanted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of ``ask`` to fetch and to split."""
    codes, kinds = gather(table, [expand, expand])
    return np.unique(codes[kinds == FETCH]).astype(np.uint64), np.unique(codes[kinds == SPLIT]).astype(np.uint64)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(some, values), len(some) - 1)
    return some[at] == values


def fetch(rule: Rule, homed: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Blobs by key: keys, contexts, least ids, times, home (-1: ``scan`` has them), size and anchor, symbols."""

    def run(key, left, right):
        want, split = _wanted(right)
        found: list[list] = [[] for _ in range(7)]
        seen = np.zeros(0, np.uint64)
        here = key[0].as_py()
        for _, data, _, ids, values, bounds, pieces, sums in each_found(rule, left) if len(want) or len(split) else ():
            codes = pieces.code
            mine = np.flatnonzero(_among(codes, want) & ~_among(codes, seen))
            mine = mine[np.unique(codes[mine], return_index=True)[1]]
            seen = np.union1d(seen, codes[mine])
            fetched = [(pieces, mine, np.full(len(mine), -1))]
            crowd = np.flatnonzero(_among(codes, split))
            if len(crowd):
                _, windows = windows_of(rule, pieces, crowd, sums, bounds)
                fetched.append((windows, np.arange(len(windows.row)), np.full(len(windows.row), here)))
            flat_of = data if rule.unit == "byte" else values
            for some, m, homes in fetched:
                low, size = bounds[some.row[m]] + some.start[m], some.size[m]
                begin = np.cumsum(size) - size
                for out, x in zip(found, (some.key[m], some.context[m], ids[some.row[m]], homes, (size << 16) + some.anchor[m], flat_of[np.repeat(low - begin, size) + np.arange(size.sum())], size), strict=True):
                    out.append(x)
        if not found[0]:
            return pa.Table.from_batches([], BLOB_SCHEMA)
        keys, contexts, ids, homes, shapes, flat, size = map(np.concatenate, found)
        begin = np.cumsum(size) - size
        # Windows of a crowded key are summed up here, as pieces were before.
        _, one, least, times = summed(code_of(keys, contexts), ids, np.ones(len(ids), np.uint8))

        def cut(m: np.ndarray) -> bytes:
            return squeeze(flat[np.repeat(begin[m] - (np.cumsum(size[m]) - size[m]), size[m]) + np.arange(size[m].sum())])

        return pa.Table.from_batches(list(deal(by_key(keys[one], n), [(keys[one], five), (contexts[one], six), (least, pack_ids), (times, squeeze), (homes[one].astype(np.int32), squeeze), (shapes[one].astype(np.int32), squeeze), (one, cut)])), BLOB_SCHEMA)

    return homed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, BLOB)


@dataclass
class Block:
    """Distinct pieces of some whole keys: key, least id, times (1, or 2 for more), size, anchor, begin in ``flat``."""

    key: np.ndarray
    least: np.ndarray
    times: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    flat: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])

    def take(self, mine: np.ndarray) -> Block:
        begin, size = self.bounds[:-1][mine], self.size[mine]
        at = np.cumsum(size) - size
        return Block(self.key[mine], self.least[mine], self.times[mine], size, self.anchor[mine], self.flat[np.repeat(begin - at, size) + np.arange(size.sum())])


def promising(rule: Rule, block: Block) -> np.ndarray:
    """The pieces that may share a window with another one of their key.

    A window reaches either half of the way to the left of its anchor or more
    (then it holds that half and the seed), or less (then it holds the anchor
    and all that a window with half on the left has on its right).
    """
    half = rule.left // 2
    sums = k.prefix(k.byte_values(block.flat) if rule.unit == "byte" else block.flat)
    begin = block.bounds[:-1]
    keep = np.zeros(len(begin), bool)
    for low, high in ((block.anchor - half, block.anchor + rule.seed), (block.anchor, block.anchor + rule.window - half)):
        fits = np.flatnonzero((low >= 0) & (high <= block.size))
        part = k.spans(sums, begin[fits] + low[fits], begin[fits] + high[fits])
        _, group, times = np.unique(part, return_inverse=True, return_counts=True)
        keep[fits[times[group] > 1]] = True
    return np.flatnonzero(keep)


def suffixes(rule: Rule, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The enhanced suffix array of a block: pieces and starts of its sorted suffixes of a window or more, their lengths, and the common prefix of each with the next."""
    size, begin = block.size, block.bounds[:-1]
    longest = int(size.max(initial=0))
    count = np.maximum(size - rule.window + 1, 0)
    piece = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    rest = size[piece] - start
    if not len(piece):
        return piece, start, rest, np.zeros(0, np.int64)
    if rule.unit == "byte":
        flat, wide = block.flat, 1
    else:  # ranks of words, 0 for what is beyond the end; big-endian bytes sort like numbers
        flat, wide = (np.unique(block.flat, return_inverse=True)[1] + 1).astype(">u4"), 4
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(longest, flat.dtype)]), longest)[begin[piece] + start]
    rows[np.arange(longest) >= rest[:, None]] = 0
    order = np.argsort(rows.view(f"S{longest * wide}").ravel(), kind="stable")
    rows, piece, start, rest = rows[order], piece[order], start[order], rest[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    return piece, start, rest, np.minimum(common, np.minimum(rest[1:], rest[:-1]))


def decide(found: DataFrame, fetched: DataFrame, match) -> DataFrame:
    """Blobs by home: codes, least ids, numbers of spans; starts, ends, kinds of all spans.

    ``match(block)`` gives (piece, start, end, later) of the spans that repeat;
    ``later``: only for documents whose id is above the piece's least.
    """

    def run(key, left, right):
        keys, contexts, ids, times, homes, shapes, flat = gather(right, [of_five, of_six, unpack_ids, expand, expand, expand, expand])
        if not len(keys):
            return pa.Table.from_batches([], BLOB_SCHEMA)
        codes, size = code_of(keys, contexts), shapes.astype(np.int64) >> 16
        _, one, _, _ = summed(codes, ids, times)
        one = one[np.argsort(keys[one], kind="stable")]
        whole = Block(keys, ids, times, size, shapes.astype(np.int64) & 0xFFFF, flat)
        # Occurrences of these pieces: those that ``scan`` has, and those that came with windows.
        k2, c2, i2, t2, h2 = gather(left, [of_five, of_six, unpack_ids, expand, expand])
        known = np.sort(codes[one])
        scanned = code_of(k2, c2)
        there, came = np.flatnonzero(_among(scanned, np.unique(codes[homes < 0]))), np.flatnonzero(homes >= 0)
        every = [np.concatenate(x) for x in ((scanned[there], codes[came]), (i2[there], ids[came]), (t2[there], times[came]), (h2[there], homes[came]))]
        _, _, least, total = summed(*every[:3])
        at = np.searchsorted(known, codes[one])
        whole.least, whole.times = ids.copy(), times.copy()
        whole.least[one], whole.times[one] = least[at], total[at]
        edges = np.append(np.flatnonzero(np.diff(keys[one], prepend=~keys[one][:1]) != 0), len(one))
        spans, low = [], 0
        while low < len(one):  # whole keys, some ``AT_ONCE`` pieces at a time
            high = int(edges[min(np.searchsorted(edges, low + AT_ONCE), len(edges) - 1)])
            piece, *rest = match(whole.take(one[low:high]))
            spans.append((piece + low, *rest))
            low = high
        piece, starts, ends, later = map(np.concatenate, zip(*spans, strict=True))
        order = np.argsort(piece, kind="stable")
        piece, starts, ends, later = piece[order], starts[order], ends[order], later[order]
        # A verdict for each occurrence of a piece that has spans.
        sent = np.searchsorted(known, every[0])
        place = np.empty(len(known), np.int64)
        place[at] = np.arange(len(one))
        of = place[sent]
        count = np.bincount(piece, minlength=len(one))[of]
        mine = np.flatnonzero(count)
        first = np.searchsorted(piece, of)

        def cut(column: np.ndarray):
            def pack(m: np.ndarray) -> bytes:
                n = count[m]
                return squeeze(column[np.repeat(first[m] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

            return pack

        columns = [(every[0][mine], squeeze), (whole.least[one][of[mine]], squeeze), (count[mine].astype(np.uint16), squeeze), *((mine, cut(x)) for x in (starts.astype(np.uint16), ends.astype(np.uint16), later.astype(np.uint8)))]
        return pa.Table.from_batches(list(deal(every[3][mine], columns)), BLOB_SCHEMA)

    return found.groupBy("bucket").cogroup(fetched.groupBy("bucket")).applyInArrow(run, BLOB)


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` symbols lie in any of the spans."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def judge(rule: Rule, docs: DataFrame, match) -> tuple[DataFrame, DataFrame]:
    """Documents by home, and blobs by home of what ``decide`` and ``ask`` say of their pieces."""
    n = buckets_for(docs)
    homed = by_home(docs, n)
    found = scan(rule, homed, n)
    asked = ask(found)
    return homed, decide(found, fetch(rule, homed, asked, n), match).unionByName(asked)


class Verdicts:
    """The verdicts that a home has got, to be looked up for many slices of its documents."""

    def __init__(self, rule: Rule, told: pa.Table):
        judged = pa.compute.is_valid(told.column("c2"))
        codes, least, count, self.starts, self.ends, self.later = gather(told.filter(judged), [expand] * 6)
        _, self.split = _wanted(told.filter(pa.compute.invert(judged)))
        order = np.argsort(codes)
        self.rule, self.codes, self.least, self.count = rule, codes[order].astype(np.uint64), least[order], count[order].astype(np.int64)
        self.begin = (np.cumsum(count, dtype=np.int64) - count)[order]

    def spans(self, ids: np.ndarray, bounds: np.ndarray, pieces: Pieces, sums: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of the spans that repeat, by row; ``every``: also where a document keeps them."""
        rows, lows, highs = [], [], []
        crowd = np.flatnonzero(_among(pieces.code, self.split))
        for some in [pieces, *([windows_of(self.rule, pieces, crowd, sums, bounds)[1]] if len(crowd) else [])]:
            mine = np.flatnonzero(_among(some.code, self.codes))
            at = np.searchsorted(self.codes, some.code[mine])
            times = self.count[at]
            of = np.repeat(mine, times)
            span = np.repeat(self.begin[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            goes = every | (self.later[span] == 0) | (ids[some.row[of]] > np.repeat(self.least[at], times))
            of, span = of[goes], span[goes]
            rows.append(some.row[of])
            lows.append(some.start[of] + self.starts[span])
            highs.append(some.start[of] + self.ends[span])
        rows, lows, highs = map(np.concatenate, (rows, lows, highs))
        order = np.argsort(rows, kind="stable")
        return rows[order], lows[order], highs[order]


def repeated(rule: Rule, docs: DataFrame, match, row, schema: str) -> DataFrame:
    """One row per document: ``row(text bytes, starts, ends)`` gives its values after doc_id, from the spans of symbols that repeat."""
    homed, told = judge(rule, docs, match)
    kinds = pa.schema([("doc_id", pa.int64()), *((x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", "))])

    def run(key, left, right):
        verdicts = Verdicts(rule, right)
        out: list[list] = [[] for _ in kinds]
        for part, data, offsets, ids, _, bounds, pieces, sums in each_found(rule, left):
            rows, lows, highs = verdicts.spans(ids, bounds, pieces, sums)
            cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
            out[0].extend(part.column(0).to_pylist())
            for i in range(part.num_rows):
                a, b = cuts[i], cuts[i + 1]
                for o, x in zip(out[1:], row(data[offsets[i] : offsets[i + 1]], lows[a:b], highs[a:b]), strict=True):
                    o.append(x)
        return pa.table([pa.array(o, f.type) for o, f in zip(out, kinds, strict=True)], schema=kinds)

    return homed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, f"doc_id bigint, {schema.replace(' long', ' bigint')}")


def occurrences(rule: Rule, docs: DataFrame, match) -> DataFrame:
    """(doc_id, start, size, repeat) of every occurrence of each span of ``match``; ``repeat`` names what stands there."""
    homed, told = judge(rule, docs, match)

    def run(key, left, right):
        verdicts = Verdicts(rule, right)
        out: list[list] = [[] for _ in range(4)]
        for part, _, _, ids, _, bounds, pieces, sums in each_found(rule, left):
            rows, lows, highs = verdicts.spans(ids, bounds, pieces, sums, every=True)
            names = k.spans(sums, bounds[rows] + lows, bounds[rows] + highs)
            for o, x in zip(out, (part.column(0).take(pa.array(rows)).to_pylist(), lows.tolist(), (highs - lows).tolist(), names.view(np.int64).tolist()), strict=True):
                o.extend(x)
        return pa.table([pa.array(o, pa.int64()) for o in out], ["doc_id", "start", "size", "repeat"])

    return homed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, "doc_id bigint, start bigint, size bigint, repeat bigint").distinct()
