"""N-gram Jaccard join with signature trees.

Documents are sets of 5-word shingles; two link when their Jaccard similarity
is at least a threshold. Equal texts are one node. A link needs a common
shingle among the first few of both sets in any one order, so each node is
filed under these; the order puts shingles last that many texts have, as a
sample of the texts tells, so that a shared passage or a common turn of phrase
is hardly ever filed, and files do not grow with the corpus. The sample sets
the order alone: every text is filed, and no link is lost in any order. Nodes
filed together form a cluster named after its least node, and each cluster is
searched with a signature tree: nodes hold the OR of their members' token
bitmaps, the range of their sizes and the greatest number of tokens that share
a bit. Two tree nodes are taken further only if the bits they share, plus that
slack, allow the overlap that their sizes need, and if they are not one
component already. A first search sees signatures alone; the components of
what may link are the clusters of a second search, which counts the overlaps
of leaves exactly. A cluster of more than ``BLOCK`` members is cut into parts
that are searched first; then only members outside its largest component meet
all others.

Nulls: null texts and texts without words have empty sets and link with
nothing; a null id keeps its row with a null component unless a linked row has
an id. Repeated rows are copies. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm import anchors as A
from epochweave.llm import kernels as k
from epochweave.llm.components import Forest, components, least_ids, sorted_overlap, stars
from epochweave.llm.names import unused
from epochweave.session import discard, materialize

WORDS, PERCENT = 5, 75
#: Of so many texts one is looked at to tell which shingles are frequent; hash cells that keep how frequent they are.
SAMPLE, CELLS = 16, 1 << 24
BLOCK = 4096
LEAF, FAN, FEW = 16, 8, 6


def shingle_sets(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and their offsets."""
    data = k.lowered(data)
    starts, ends, bounds = k.words(data, offsets)
    n = np.diff(bounds)
    sums = k.prefix(k.word_hashes(data, starts, ends))
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.cumsum(count)
    first = bounds[:-1][row] + np.arange(len(row)) - np.repeat(at - count, count)
    grams = k.spans(sums, first, first + np.minimum(n, words)[row])
    for a, b in zip((at - count).tolist(), at.tolist(), strict=True):  # row by row: far quicker than by two keys
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[fresh], row[fresh]
    return grams, np.searchsorted(row, np.arange(len(n) + 1))


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> k.U64(65 - CELLS.bit_length())).astype(np.int64)


def _frequent(docs: DataFrame, words: int, n: int) -> bytes:
    """How frequent the shingles of each cell are: 0, or the rounded logarithm of the number of sampled texts that have the commonest one.

    At most ``CELLS`` bytes, squeezed, come to the driver, however many texts there are.
    """
    bits = min(max(n - 1, 1).bit_length(), 14)

    def distinct(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            yield batch.take(pa.array([i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)], pa.int64()))

    def grams(batches):
        for batch in distinct(batches):
            for part, data, offsets in k.slices(batch, "text"):
                mine, _ = shingle_sets(part, data, offsets, words)
                yield from A.deal(mine >> k.U64(64 - bits), [(mine, lambda x: A.squeeze(np.sort(x)))])

    def levels(key, table):
        mine = np.sort(A.gather(table, [A.expand])[0])
        at = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        times = np.diff(at, append=len(mine))
        often = times > 1
        out = np.zeros(CELLS >> bits, np.uint8)
        np.maximum.at(out, _cell(mine[at[often]]) & (CELLS >> bits) - 1, np.log2(times[often]).round().astype(np.uint8))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([A.squeeze(out)], pa.binary())})

    few = docs.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("node", "text")
    # Copies are dropped within tasks first, so that a text's copies meet once a task.
    few = few.mapInArrow(distinct, few.schema).repartition(n, "node").mapInArrow(grams, A.BLOB)
    out = np.zeros(CELLS, np.uint8)
    for r in few.groupBy("bucket").applyInArrow(levels, "part int, levels binary").collect():
        mine = A.expand(r["levels"])
        out[r["part"] * len(mine) :][: len(mine)] = mine
    return A.squeeze(out)


def rarest(levels: np.ndarray, bounds: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Indices of the first ``most`` items of each row, by level and then by place."""
    row = k.rows_of(bounds)
    rare = levels == 0
    before = np.concatenate([[0], np.cumsum(rare)])
    taken = np.flatnonzero(rare & (before[:-1] - before[bounds[:-1]][row] < most[row]))
    short = most - np.diff(before[bounds])
    rest = np.flatnonzero(~rare & (short[row] > 0))
    rest = rest[np.lexsort((levels[rest], row[rest]))]
    place = np.arange(len(rest)) - np.searchsorted(row[rest], row[rest])
    return np.concatenate([taken, rest[place < short[row[rest]]]])


DOC = "doc_id bigint, node bigint, n_shingles bigint, signature binary"


def _filed(docs: DataFrame, frequent: bytes, words: int, percent: int, n: int) -> DataFrame:
    """Rows of two kinds: ``DOC`` rows, without a bucket, a node's signature once a task; and blobs by shingle: the first shingles of each set, with node and set size."""

    def run(batches):
        levels = A.expand(frequent)
        seen: set[int] = set()
        for batch in batches:
            found: list[list] = [[], [], []]
            for part, data, offsets in k.slices(batch, "text"):
                nodes = np.asarray(part.column(2))
                fresh = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], bool)
                grams, bounds = shingle_sets(part, data, offsets, words)
                size = np.diff(bounds)
                signed = [bitmaps([grams[a:b]], signature_width(b - a)).tobytes() if x and b > a else None for x, a, b in zip(fresh.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(size), t) for t in A.BLOB_SCHEMA.types), part.column(0), part.column(2), pa.array(size.astype(np.int64)), pa.array(signed, pa.binary())], names)
                # Linked sets share percent of the larger one at least, so one of any (size - that + 1) is shared.
                mine = rarest(levels[_cell(grams)], bounds, np.where(fresh & (size > 0), size - -(-percent * size // 100) + 1, 0))
                row = k.rows_of(bounds)[mine]
                for out, x in zip(found, (grams[mine], nodes[row], size[row].astype(np.int32)), strict=True):
                    out.append(x)
            if len(seen) > 1_000_000:
                seen.clear()
            if found[0]:
                grams, nodes, size = map(np.concatenate, found)
                for blobs in A.deal((grams >> k.U64(40)) % k.U64(n), [(grams, lambda x: A.squeeze(A.narrow(x, A.KEY))), (nodes, A.squeeze), (size, A.squeeze)]):
                    yield pa.RecordBatch.from_arrays([*blobs.columns, *[pa.nulls(blobs.num_rows, pa.int64())] * 3, pa.nulls(blobs.num_rows, pa.binary())], names)

    names = [*A.BLOB_SCHEMA.names, "doc_id", "node", "n_shingles", "signature"]
    return docs.select("doc_id", "text", "node").mapInArrow(run, f"{A.BLOB}, {DOC}")


def _clusters(blobs: DataFrame, percent: int) -> DataFrame:
    """(leader, node): who is filed together; sizes too far apart part a file."""

    def run(key, table):
        grams, nodes, size = A.gather(table, [lambda x: A.widen(A.expand(x), A.KEY), A.expand, A.expand])
        order = np.argsort(grams)
        again = grams[order][1:] == grams[order][:-1]  # most shingles are filed once
        order = order[np.concatenate([again, [False]])[: len(order)] | np.concatenate([[False], again])[: len(order)]]
        order = order[np.lexsort((nodes[order], size[order], grams[order]))]
        grams, nodes, size = grams[order], nodes[order], size[order].astype(np.int64)
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
        grams, nodes, size = grams[fresh], nodes[fresh], size[fresh]
        cut = np.ones(len(grams), bool)
        cut[1:] = (grams[1:] != grams[:-1]) | (100 * size[:-1] < percent * size[1:])
        group = np.cumsum(cut) - 1
        many = np.bincount(group, minlength=1)[group] > 1
        at = np.flatnonzero(cut)
        leader = np.minimum.reduceat(nodes, at)[group] if len(at) else nodes
        pairs = np.unique(np.stack([leader[many], nodes[many]], axis=1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
        return pa.table({"leader": pa.array(pairs[:, 0].copy()), "node": pa.array(pairs[:, 1].copy())})

    return blobs.groupBy("bucket").applyInArrow(run, "leader bigint, node bigint").distinct()


class Tree:
    """A signature tree over some of the sets of a cluster."""

    def __init__(self, members: np.ndarray, bits: np.ndarray, sizes: np.ndarray, slack: np.ndarray):
        self.levels: list[list[tuple]] = [[]]
        for a in range(0, len(members), LEAF):
            m = members[a : a + LEAF]
            self.levels[0].append((np.bitwise_or.reduce(bits[m], axis=0), int(sizes[m].min()), int(sizes[m].max()), int(slack[m].max()), m, ()))
        while len(self.levels[-1]) > 1:
            low, high = self.levels[-1], []
            for a in range(0, len(low), FAN):
                kids = low[a : a + FAN]
                high.append((np.bitwise_or.reduce(np.stack([x[0] for x in kids]), axis=0), min(x[1] for x in kids), max(x[2] for x in kids), max(x[3] for x in kids), np.concatenate([x[4] for x in kids]), tuple(kids)))
            self.levels.append(high)

    @property
    def root(self) -> tuple:
        return self.levels[-1][0]


def may_link(x: tuple, y: tuple, percent: int) -> bool:
    """Whether a set below x and one below y can be similar enough, by sizes and by the greatest possible overlap."""
    if 100 * x[2] < percent * y[1] or 100 * y[2] < percent * x[1]:
        return False
    most = min(int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3]), x[2], y[2])
    return most * (100 + percent) >= percent * (x[1] + y[1])


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """One row of ``width`` bits a set: the bit of each token's low digits."""
    out = np.zeros((len(sets), width // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64)
    np.bitwise_or.at(out, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def traverse(bits: np.ndarray, sizes: np.ndarray, sides: np.ndarray, percent: int, forest: Forest, names: list, test=None) -> list[tuple[int, int]]:
    """Pairs that together join each component of pairs that may link (and pass ``test``), by dual traversal.

    Pairs whose ``names`` are one component in ``forest`` already are skipped.
    With two ``sides``, only pairs across them count: each has its own task.
    """
    slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    order = np.lexsort((bits[:, 0], sizes))
    trees = [Tree(order[sides[order] == s], bits, sizes, slack).root for s in np.unique(sides)]
    out, stack = [], [(trees[0], trees[-1])]
    while stack:
        x, y = stack.pop()
        if not may_link(x, y, percent):
            continue
        if len({forest.find(names[i]) for i in x[4]} | {forest.find(names[i]) for i in y[4]}) == 1:
            continue
        if x[5] or y[5]:
            left, right = x[5] or (x,), y[5] or (y,)
            stack.extend((a, b) for i, a in enumerate(left) for j, b in enumerate(right) if x is not y or i <= j)
            continue
        for i in x[4].tolist():
            common = np.bitwise_count(bits[i] & bits[y[4]]).sum(axis=1).astype(np.int64) + np.minimum(slack[i], slack[y[4]])
            most = np.minimum(common, np.minimum(sizes[i], sizes[y[4]]))
            for j in y[4][most * (100 + percent) >= percent * (sizes[i] + sizes[y[4]])].tolist():
                if (x is y and i >= j) or names[i] == names[j] or forest.find(names[i]) == forest.find(names[j]):
                    continue
                if test is None or test(i, j):
                    forest.join(names[i], names[j])
                    out.append((i, j))
    return out


def link_cluster(sets: list[np.ndarray], sides: np.ndarray, percent: int, edit: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of linked sets that together join each component; overlaps are counted exactly.

    With ``edit``, at most so many items of the larger set may be missing in the other.
    """
    sizes = np.array([len(s) for s in sets])
    width = 1 << int(np.clip(np.ceil(np.log2(4 * sizes.max())), 8, 16))

    def exact(i: int, j: int) -> bool:
        common = sorted_overlap(sets[i], sets[j])
        return common * (100 + percent) >= percent * (sizes[i] + sizes[j]) and (edit is None or max(sizes[i], sizes[j]) - common <= edit)

    if len(sets) <= FEW:  # a tree of one leaf: its pairs
        forest = Forest()
        across = len(np.unique(sides)) > 1
        pairs = ((i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if not across or sides[i] != sides[j])
        return [(i, j) for i, j in pairs if forest.find(i) != forest.find(j) and exact(i, j) and forest.join(i, j)]
    return traverse(bitmaps(sets, width), sizes, sides, percent, Forest(), list(range(len(sets))), exact)


def signature_width(size: int) -> int:
    """Bits of a set's signature: two to four times its size, so at most twice as many for one that it can link with."""
    return 1 << max(8, (2 * size - 1).bit_length())


def signatures_allow(x: np.ndarray, y: np.ndarray, m: int, n: int, percent: int) -> bool:
    """Whether sets of ``m`` and ``n`` items with these signatures can be similar enough: ``may_link`` for two sets alone."""
    if 100 * min(m, n) < percent * max(m, n):
        return False
    if len(x) != len(y):
        x, y, m, n = (x, y, m, n) if len(x) < len(y) else (y, x, n, m)
        y = y[: len(x)] | y[len(x) :]
    bits = lambda z: int(np.bitwise_count(z).sum(dtype=np.int64))
    most = min(bits(x & y) + min(m - bits(x), n - bits(y)), m, n)
    return most * (100 + percent) >= percent * (m + n)


def candidate_pairs(maps: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray, nodes: list, percent: int) -> list[tuple[int, int]]:
    """Index pairs that together join each component of sets that may link by their signatures.

    Sets that can link have widths that differ by a factor of 2 at most; the wider one is folded.
    """
    forest, out = Forest(), []
    if len(maps) <= FEW:  # as in link_cluster
        across, of, side = len(np.unique(sides)) > 1, sizes.tolist(), sides.tolist()
        pairs = ((i, j) for i in range(len(maps)) for j in range(i + 1, len(maps)) if not across or side[i] != side[j])
        return [(i, j) for i, j in pairs if forest.find(nodes[i]) != forest.find(nodes[j]) and signatures_allow(maps[i], maps[j], of[i], of[j], percent) and forest.join(nodes[i], nodes[j])]
    widths = np.array([len(m) for m in maps])
    for w in np.unique(widths).tolist():
        mine = np.flatnonzero((widths == w) | (widths == 2 * w))
        if len(mine) < 2 or len(np.unique(sides[mine])) < len(np.unique(sides)):
            continue
        bits = np.stack([maps[i] if widths[i] == w else maps[i][:w] | maps[i][w:] for i in mine])
        out += [(int(mine[i]), int(mine[j])) for i, j in traverse(bits, sizes[mine], sides[mine], percent, forest, [nodes[i] for i in mine])]
    return out


#: What is added to the second part of a task that compares two sides.
_ACROSS = 1 << 30
TASK = "node bigint, leader bigint, one int, two int, side int"


def within_parts(clusters: DataFrame) -> DataFrame:
    """``TASK`` rows of (leader, node): each part of a cluster is one task, and each member is in one of them."""
    many = clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK)
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)), F.lit(0)).cast("int")
    return clusters.join(many, "leader", "left").select("node", "leader", part.alias("one"), part.alias("two"), F.lit(0).alias("side"))


def across_parts(clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """``TASK`` rows of the pairs that ``within_parts`` has not seen and that may join components.

    Of a cluster of several parts, the members outside its largest component
    (by ``roots``) meet all members; a cluster that is one component, as a
    group of near copies soon is, needs nothing more.
    """
    many = clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK)
    large = clusters.join(many, "leader").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = large.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("leader").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"))
    placed = large.join(main, "leader").where(F.col("n_main") < F.col("members")).withColumn("rest", F.ceil((F.col("members") - F.col("n_main")) / BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    apart = placed.where(F.col("root") != F.col("main")).select("node", "leader", F.pmod(F.xxhash64("node", F.lit(1)), "rest").cast("int").alias("one"), spread("parts").alias("two"), F.lit(1).alias("side"))
    whole = placed.select("node", "leader", spread("rest").alias("one"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("two"), F.lit(0).alias("side"))
    return apart.unionByName(whole).withColumn("two", F.col("two") + _ACROSS)


def linked_roots(clusters: DataFrame, links) -> DataFrame:
    """(node, root) of the components of all links within clusters; ``links(tasks)`` finds those of ``TASK`` rows."""
    roots = components(links(within_parts(clusters)))
    more = materialize(across_parts(clusters, roots), "across")
    if more.isEmpty():
        discard(more)
        return roots
    return components(links(more).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _bucket(column: str, n: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(n)).cast("int")


def wanted_by(table: pa.Table) -> dict[int, list[tuple[int, int, int, int]]]:
    """The tasks (leader, one, two, side) of each node of ``TASK`` rows."""
    want = defaultdict(list)
    for node, *task in zip(*(table.column(c).to_pylist() for c in ("node", "leader", "one", "two", "side")), strict=True):
        want[node].append(tuple(task))
    return want


def member_blobs(rows: list[tuple], sets: list[np.ndarray], n: int) -> pa.Table:
    """Blobs by cluster task from (leader, first part, second part, side, node, set size, array length) and the arrays."""
    if not rows:
        return pa.Table.from_batches([], A.BLOB_SCHEMA)
    leader, one, two, side, node, size, length = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    group = (k.mix(leader.astype(np.uint64) + (one * 65537 + two).astype(np.uint64)) % k.U64(n)).astype(np.int64)
    flat = lambda m: A.squeeze(np.concatenate([sets[i] for i in m]))
    return pa.Table.from_batches(list(A.deal(group, [(leader, A.squeeze), ((one << 32) | two, A.squeeze), (side.astype(np.int8), A.squeeze), (node, A.squeeze), ((size << 32) | length, A.squeeze), (np.arange(len(rows)), flat)])), A.BLOB_SCHEMA)


#: Words of 64 bits that tell which nodes a search may want.
MARKS = 1 << 18


def marks(tasks: DataFrame) -> np.ndarray:
    """A bit for every node of ``tasks``, shared by nodes that end alike: at most ``MARKS`` rows are collected, however many nodes there are."""
    node = F.col("node")
    words = tasks.groupBy(F.shiftright(node, 6).bitwiseAND(MARKS - 1).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), node.bitwiseAND(63).cast("int"))).alias("bits"))
    out = np.zeros(MARKS, np.uint64)
    for r in words.collect():
        out[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


def marked(nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which nodes may be among those that ``bits`` were made of; all that are, are."""
    some = nodes.view(np.uint64)
    return (bits[((some >> k.U64(6)) & k.U64(MARKS - 1)).astype(np.int64)] >> (some & k.U64(63)) & k.U64(1)).astype(bool)


def _texts(docs: DataFrame, n: int, bits: np.ndarray) -> DataFrame:
    """(node, text, bucket): the texts that may be wanted, each at most once from a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            hit = np.flatnonzero(marked(np.asarray(batch.column(0)), bits)).tolist()
            nodes = batch.column(0).to_pylist()
            fresh = [i for i in hit if nodes[i] not in seen and not seen.add(nodes[i])]
            yield batch.take(pa.array(fresh, pa.int64()))
            if len(seen) > 1_000_000:
                seen.clear()

    return docs.select("node", "text").mapInArrow(run, "node bigint, text string").withColumn("bucket", _bucket("node", n))


def _signed(signatures: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """Blobs by cluster task: leader, first and second part, side, node, set size, signature."""

    def run(key, left, right):
        want = wanted_by(right)
        rows, maps = [], []
        for node, size, raw in zip(*(left.column(c).to_pylist() for c in ("node", "n_shingles", "signature")), strict=True):
            for leader, one, two, side in want.pop(node, ()):
                rows.append((leader, one, two, side, node, size, len(raw) // 8))
                maps.append(np.frombuffer(raw, np.uint64))
        return member_blobs(rows, maps, n)

    return signatures.groupBy("bucket").cogroup(tasks.groupBy("bucket")).applyInArrow(run, A.BLOB)


def _members(docs: DataFrame, tasks: DataFrame, words: int, n: int) -> DataFrame:
    """Blobs by cluster task: leader, first and second part, side, node, set size, set."""

    def run(key, left, right):
        want = wanted_by(right)
        rows, sets = [], []
        for part, data, offsets in A.each_slice(left):
            nodes = part.column(part.schema.get_field_index("node")).to_pylist()
            wanted = [i for i, node in enumerate(nodes) if node in want]
            if not wanted:
                continue
            grams, bounds = shingle_sets(part, data, offsets, words)
            for i in wanted:
                mine = grams[bounds[i] : bounds[i + 1]].copy()
                for leader, one, two, side in want.pop(nodes[i], ()):
                    rows.append((leader, one, two, side, nodes[i], len(mine), len(mine)))
                    sets.append(mine)
        return member_blobs(rows, sets, n)

    return docs.groupBy("bucket").cogroup(tasks.groupBy("bucket")).applyInArrow(run, A.BLOB)


def each_task(table: pa.Table):
    """(leader, nodes, sizes, sides, parts of the flat column) of each cluster task in a group."""
    leader, parts, side, node, size, flat = A.gather(table, [A.expand] * 6)
    if not len(leader):
        return
    size, length = size >> 32, size & 0xFFFFFFFF
    begin = np.cumsum(length) - length
    order = np.lexsort((parts, leader))
    cut = np.flatnonzero(np.concatenate([[True], (leader[order][1:] != leader[order][:-1]) | (parts[order][1:] != parts[order][:-1])]))
    for lo, hi in zip(cut, [*cut[1:], len(order)], strict=True):
        mine = order[lo:hi]
        one_part = (parts[mine[0]] & 0xFFFFFFFF) < _ACROSS
        sides = np.zeros(len(mine), np.int8) if one_part else side[mine]
        if len(mine) > 1 and (one_part or len(np.unique(sides)) == 2):
            yield int(leader[mine[0]]), node[mine].tolist(), size[mine], sides, [flat[begin[m] : begin[m] + length[m]] for m in mine]


def _links(blobs: DataFrame, percent: int, exact: bool = True) -> DataFrame:
    """(a, b): pairs that join the nodes of each cluster task that link (or, by signatures, may link)."""

    def run(key, table):
        pairs = []
        for _, nodes, sizes, sides, sets in each_task(table):
            found = link_cluster(sets, sides, percent) if exact else candidate_pairs(sets, sizes, sides, nodes, percent)
            pairs += [(nodes[i], nodes[j]) for i, j in found]
        return stars(pairs)

    return blobs.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, node, n_shingles, component_id, root): ``node`` is the text's hash, ``component_id`` the least id reachable by links, ``root`` the least text hash."""
    n = A.buckets_for(docs)
    noded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    filed = materialize(_filed(noded, _frequent(noded, words, n), words, percent, n), "filed")
    clusters = materialize(_clusters(filed.where("bucket IS NOT NULL").select(*A.BLOB_SCHEMA.names), percent), "clusters")
    # The blobs go; what was told of each document is written anew, as it is needed to the end.
    known = materialize(filed.where("bucket IS NULL").select("doc_id", "node", "n_shingles"), "known")
    signatures = materialize(filed.where("signature IS NOT NULL").select("node", "n_shingles", "signature").withColumn("bucket", _bucket("node", n)), "signatures")
    discard(filed)
    # Signatures first: what may link makes clusters that do not overlap, so each whole set travels once.
    dealt = lambda tasks: tasks.withColumn("bucket", _bucket("node", n))
    hopeful = linked_roots(clusters, lambda tasks: _links(_signed(signatures, dealt(tasks), n), percent, exact=False))
    close = hopeful.select(F.col("root").alias("leader"), "node")
    # One row of each text that may link goes on: copies are dropped within each task before texts are sent anywhere.
    roots = linked_roots(close, lambda tasks: _links(_members(_texts(noded, n, marks(tasks)), dealt(tasks), words, n), percent))
    discard(signatures)
    discard(clusters)
    texts = known.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    # Written, so that the last join is of two plain tables, whose crowded keys Spark may split.
    components_of = materialize(least_ids(texts, roots), "components")
    joined = known.join(components_of, "node", "left")
    alone = F.col("n_shingles") == 0
    return joined.select("doc_id", "node", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component; unlinked and empty ones stay.

    That of the least id stays, so one without an id goes if any other has one;
    if none has, the text of the least hash stays. Repeated rows of the kept id
    and text stay together.
    """
    gone_id, gone_node, node = unused(docs, "gone_id", "gone_node", "node")
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("node") == F.col("root")))
    found = near_duplicates(docs, words, percent).where((F.col("n_shingles") > 0) & ~stays).select(F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node)).distinct()
    keyed = docs.withColumn(node, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(node) == F.col(gone_node)), "left_anti").drop(node)


def op2(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
