"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint of 64 bits has a bit set where more than half of the hashes of
its text's shingles have it. Fingerprints link at ``BITS`` = 3 or fewer
differing bits; equal ones are one node. A fingerprint is cut into three
segments of 22, 21 and 21 bits, which are words of the perfect Golay code of
length 23 (with zeros before them). Three errors in three segments leave two
segments with one error at most each: with two of them at two errors there
would be four. The code words around a segment are its keys: the nearest one,
at most 3 bits away, and those at exactly 4 bits, of which a segment has five
or, if the nearest is closer than 3, none. If two segments differ in one bit,
the nearest word of either is at most 4 bits from the other, so it is among
the other's keys.

So each fingerprint is at home under the nearest words of any two segments,
and also looks under every pair of words around them, of which only those
above its own home count, as each link is seen from both ends. Who meets under
a key is compared bit by bit, and links become components by distributed
union-find. Groups of more than ``FEW`` fingerprints are searched from node to
node, so a group of near copies gives a tree of links and not all its pairs;
those of more than ``CROWD`` are cut into parts that meet each other
(``jaccard.linked_roots``). Under a key stand distinct fingerprints of 8 bytes.

Nulls: null texts and texts without words have the fingerprint zero, which
links like any other; a null id keeps its row, with a null component unless a
linked row has an id. Repeated rows share their fingerprint. Texts of fewer
words than a shingle are one shingle. Very long texts are hashed in blocks of
shingles; a worker holds one text. Ties, as many ones as zeros, give a zero.
Empty tables give empty results. Only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm import anchors as A
from epochweave.llm import jaccard as J
from epochweave.llm import kernels as k
from epochweave.llm.components import components, least_ids, stars
from epochweave.session import discard, materialize

WORDS, SEED, BITS = 3, 42, 3
#: Fingerprints of a group that are compared pair by pair; and those that one task searches.
FEW, CROWD = 32, 1 << 15
#: Shingles that are counted at once; pairs that are compared at once; bytes of keys that a bucket holds on average.
AT_ONCE, PAIRS, BUCKET = 1 << 15, 1 << 21, 64 << 20
#: The Golay code's length, its message bits, and its generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
LENGTH, MESSAGE, GENERATOR = 23, 12, 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
TOGETHER = ((0, 1), (0, 2), (1, 2))
#: Keys of a fingerprint on average: half of 5.32 squared, for three pairs of segments.
KEYS = 44


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of the words of a text, its capitals A-Z made small."""
    found = text.lower().split()
    if not found:
        return 0
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    size = min(words, len(found))
    first = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1].tolist()
    last = ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    of = xxhash.xxh64_intdigest
    for at in range(0, len(first), AT_ONCE):
        hashes = np.array([of(flat[a:b], seed) for a, b in zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each row; ``fp`` is the fingerprint as a signed number."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


class Golay:
    """Code words around segments, by syndromes."""

    def __init__(self):
        rest = [1]
        for _ in range(LENGTH - 1):
            x = rest[-1] << 1
            rest.append(x ^ GENERATOR if x >> (LENGTH - MESSAGE) else x)
        by_bit = np.array(rest, np.int64)
        half = LENGTH - MESSAGE
        table = lambda bits: np.bitwise_xor.reduce(np.where(np.arange(1 << len(bits))[:, None] >> np.arange(len(bits)) & 1, bits, 0), axis=1)
        self.low, self.high = table(by_bit[:half]), table(by_bit[half:])
        self.leader, self.weight = np.zeros(1 << half, np.int64), np.zeros(1 << half, np.int64)
        self.near = np.zeros((1 << half, 5), np.int64)
        for errors in range(1, 5):
            places = np.array(list(combinations(range(LENGTH), errors)))
            pattern, syndrome = (1 << places).sum(axis=1), np.bitwise_xor.reduce(by_bit[places], axis=1)
            if errors < 4:
                self.leader[syndrome], self.weight[syndrome] = pattern, errors
            else:  # five for each syndrome of three errors
                order = np.argsort(syndrome, kind="stable")
                self.near[syndrome[order[::5]]] = pattern[order].reshape(-1, 5)

    def keys(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of code words, which of them count) of each segment: the nearest one, then five at 4 bits."""
        half = LENGTH - MESSAGE
        syndrome = self.low[segments & ((1 << half) - 1)] ^ self.high[segments >> half]
        nearest = segments ^ self.leader[syndrome]
        more = segments[:, None] ^ self.near[syndrome]
        found = np.concatenate([nearest[:, None], more], axis=1) >> half
        counts = np.ones(found.shape, bool)
        counts[:, 1:] = (self.weight[syndrome] == 3)[:, None]
        return found, counts


def keys_of(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint): a key's last bit is 0 at home and 1 for a search; its first ones tell the pair of segments."""
    around = [code.keys((fps >> k.U64(at) & k.U64((1 << size) - 1)).astype(np.int64)) for at, size in SEGMENTS]
    keys, rows = [], []
    for pair, (i, j) in enumerate(TOGETHER):
        both = (around[i][0][:, :, None] << MESSAGE | around[j][0][:, None, :]).reshape(len(fps), 36)
        counts = (around[i][1][:, :, None] & around[j][1][:, None, :]).reshape(len(fps), 36)
        home = both[:, :1]
        counts &= both > home
        counts[:, 0] = True
        row, column = np.nonzero(counts)
        keys.append((pair << 2 * MESSAGE | both[row, column]) << 1 | (column > 0))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _filed(nodes: DataFrame, n: int) -> DataFrame:
    """Blobs by key: keys and fingerprints."""

    def run(batches):
        code = Golay()
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fps), AT_ONCE):
                some = fps[at : at + AT_ONCE]
                keys, row = keys_of(some, code)
                yield from A.deal(k.mix((keys >> 1).astype(np.uint64)) % k.U64(n), [(keys.astype(np.uint32), A.squeeze), (some[row], A.squeeze)])

    return nodes.select("fp").mapInArrow(run, A.BLOB)


def close(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(left ^ right) <= bits


def spanned(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join each component of some distinct fingerprints: a search from each node to those not yet found."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            found = close(rest, x, bits)
            if found.any():
                near, rest = rest[found], rest[~found]
                out.append((np.full(len(near), x), near))
                queue.extend(near)
    return out


def within(group: np.ndarray, home: np.ndarray, fps: np.ndarray, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of fingerprints that share a key, and the places of those in crowded groups; rows are sorted by group, those at home first."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    size = np.diff(np.append(first, len(group)))
    homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
    few = np.flatnonzero((homes > 0) & (size > 1) & (size <= FEW))
    out, count = [], np.cumsum(homes[few] * size[few])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(count, np.arange(PAIRS, count[-1] if len(count) else 0, PAIRS)), [len(few)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        g = few[a:b]
        left = np.repeat(first[g], homes[g]) + _steps(homes[g])
        times = np.repeat(size[g], homes[g])
        right = np.repeat(np.repeat(first[g], homes[g]), times) + _steps(times)
        left = np.repeat(left, times)
        mine = np.flatnonzero(close(fps[left], fps[right], bits) & (left != right))
        out.append((fps[left[mine]], fps[right[mine]]))
    for g in np.flatnonzero((homes > 0) & (size > FEW) & (size <= CROWD)).tolist():
        out += spanned(fps[first[g] : first[g] + size[g]], bits)
    crowd = np.flatnonzero((homes > 0) & (size > CROWD))
    return out, np.repeat(first[crowd], size[crowd]) + _steps(size[crowd])


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _star(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    if not links:
        return stars([])
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return stars(zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), strict=True))


def _met(blobs: DataFrame, bits: int) -> DataFrame:
    """(a, b, crowded): links; where crowded, a is a key and b a fingerprint under it."""

    def run(key, table):
        keys, fps = A.gather(table, [A.expand, A.expand])
        order = np.argsort(keys, kind="stable")
        keys, fps = keys[order].astype(np.int64), fps[order].astype(np.uint64)
        links, crowd = within(keys >> 1, keys & 1 == 0, fps, bits)
        found = _star(links)
        found = found.append_column("crowded", pa.array(np.zeros(found.num_rows, bool)))
        return pa.concat_tables([found, pa.table({"a": pa.array(keys[crowd] >> 1), "b": pa.array(fps[crowd].view(np.int64)), "crowded": pa.array(np.ones(len(crowd), bool))})])

    return blobs.groupBy("bucket").applyInArrow(run, "a bigint, b bigint, crowded boolean")


def _crowd_links(tasks: DataFrame, bits: int) -> DataFrame:
    """(a, b): links within each task of ``jaccard.linked_roots``."""

    def run(key, table):
        return _star(spanned(np.unique(np.asarray(table.column("node").combine_chunks())).view(np.uint64), bits))

    return tasks.groupBy("leader", "one", "two").applyInArrow(run, "a bigint, b bigint")


def linked(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, root) of all distinct fingerprints (fp) that link with another one at ``bits`` (at most 3) differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments are only sure to be nearly equal at 3 differing bits or fewer")
    spark = nodes.sparkSession
    n = max(A.buckets(spark), -(-nodes.count() * KEYS * 12 // BUCKET))
    met = materialize(_met(_filed(nodes, n), bits), "links")
    links = met.where("not crowded").select("a", "b")
    crowded = met.where("crowded").select(F.col("a").alias("leader"), F.col("b").alias("node"))
    if not crowded.isEmpty():
        more = J.linked_roots(crowded, lambda tasks: _crowd_links(tasks, bits))
        links = links.unionByName(more.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(links)
    discard(met)
    return roots


def near_copies(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of each row; ``component_id`` is the least id reachable by links."""
    known = materialize(fingerprints(docs, words, seed), "fingerprints")
    roots = linked(known.select("fp").distinct(), bits)
    ids = materialize(least_ids(known.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), roots), "components")
    return known.join(ids, known["fp"] == ids["node"], "left").select("doc_id", "fp", "component_id")


def op12(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    out = near_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
