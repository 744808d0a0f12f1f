"""Fuzzy line dedup by MinHash.

Lines that are not blank (small letters, trimmed) are nodes, and equal lines
are one node, however short. Those of at least ``least`` characters are also
compared with others: they are sets of character shingles. MinHash signatures are cut into
bands; nodes that share a band form a cluster named after its least node, in
which similarities are counted exactly (by the search of ``jaccard``); links
make components by distributed union-find. Of each component, and of each
repeated line, only the first occurrence stays: least document id, then least
line. Blank lines always stay.

Long lines have shingles of 8 characters; with 16 bands of 5 rows, a pair at
the threshold of 0.8 becomes a candidate with probability 0.998. Shingles are
that long because lines of several hundred characters of one language share
many shorter ones. One edited word is too much for that rule in a short line,
so lines under 128 characters are compared by shingles of 4 characters, too:
they link if at most 12 of the larger set are not common (an edited word of
nine letters, or three edited letters) and the similarity is 0.55 at least. A
line of 128 characters that differs in 12 such shingles has 0.82 there and is
found by the rule of long lines if they stand together, so the rules overlap
from 80 to 128. Lines that differ in one word of up to 12 characters always
become candidates, by keys of the line without each of its words, and so do
lines that differ inside up to three words, by keys of any two of five parts
of their words; others by 16 bands of 6 rows, with probability 0.87 at 0.7 and
0.99 at 0.8. The tests ask for 95 % of all pairs that link by the rules, by
length and kind of edit. Lines under 80 characters that link by the rule of
long lines do so by this one, so they have only its keys.

Nulls: a null text has no lines and stays null; a null id counts as larger
than all others. Repeated rows (id and text) count as one document and keep
their lines together. Empty tables give empty results. Extra columns stay.
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
from epochweave.llm.components import stars
from epochweave.llm.names import quoted, unused
from epochweave.session import discard, materialize

LEAST, CHARS, PERCENT = 40, 8, 80
BANDS, ROWS = 16, 5
#: Lines under ``SHORT`` characters: shingles, similarity, shingles that may differ, bands. From ``LONG`` characters on, the rule above counts as well.
SHORT, LONG = 128, 80
SHORT_CHARS, SHORT_PERCENT, SHORT_EDIT = 4, 55, 12
SHORT_BANDS, SHORT_ROWS = 16, 6
#: Parts of a short line of which any two are a key, and letters that these two hold at least.
GROUPS, GROUP_LETTERS = 5, 8
#: Parts in which the lines of a component look up their first line.
SALTS = 32
#: Characters of distinct lines that a task holds before it passes them on.
HELD = 6 << 20
#: Lines that are hashed at once.
AT_ONCE = 2000
_random = np.random.default_rng(20240301)
_FACTORS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHORT_FACTORS = _random.integers(0, 1 << 32, SHORT_BANDS * SHORT_ROWS, dtype=np.uint32) | np.uint32(1)


def normal_lines(text: str, least: int):
    """(line number, normalised line) of the lines of at least ``least`` characters."""
    for i, line in enumerate(text.split("\n")):
        line = line.strip().lower()
        if len(line) >= least:
            yield i, line


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _occurrences(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, nodes, numbers, lines = [], [], [], []
            for doc_id, text, node in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for i, line in normal_lines(text.as_py() or "", 1):
                    ids.append(doc_id)
                    nodes.append(node)
                    numbers.append(i)
                    lines.append(line_id(line))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lines, pa.int64())], ["doc_id", "node", "line_no", "line_id"])

    return docs.select("doc_id", "text", "node").mapInArrow(run, "doc_id bigint, node bigint, line_no int, line_id bigint")


def fresh_lines(batches, least: int):
    """Blocks {line id: line} of the lines of a task; equal lines of a block go once."""
    found: dict[int, str] = {}
    held = 0
    for batch in batches:
        for text in batch.column(0):
            for _, line in normal_lines(text.as_py() or "", least):
                key = line_id(line)
                if key not in found:
                    found[key] = line
                    held += len(line)
            if held > HELD:
                yield found
                found, held = {}, 0
    if found:
        yield found


def _texts(docs: DataFrame, least: int, n: int, bits: np.ndarray) -> DataFrame:
    """Blobs by line of the lines that may be wanted: line ids, byte lengths, bytes."""

    def run(batches):
        for found in fresh_lines(batches, least):
            hit = J.marked(np.fromiter(found, np.int64, len(found)), bits).tolist()
            found = {i: x for (i, x), wanted in zip(found.items(), hit, strict=True) if wanted}
            if not found:
                continue
            ids, raw = np.fromiter(found, np.int64, len(found)), [x.encode() for x in found.values()]
            size = np.fromiter(map(len, raw), np.int32, len(raw))
            yield from A.deal(_home(ids, n), [(ids, A.squeeze), (size, A.squeeze), (np.arange(len(raw)), lambda m, raw=raw: A.squeeze(np.frombuffer(b"".join(raw[i] for i in m), np.uint8)))])
            pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(run, A.BLOB)


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of lines by their ids, as ``pmod`` has it."""
    return ids % n


def _wanted_lines(table: pa.Table, want: dict):
    """Line id and bytes of each wanted line of a group, once."""
    seen: set[int] = set()
    for row in table.select(["c0", "c1", "c2"]).to_batches(1):
        ids, size = (A.expand(row.column(i)[0].as_py()) for i in range(2))
        mine = [i for i, x in enumerate(ids.tolist()) if x in want and x not in seen and not seen.add(x)]
        if mine:
            flat, end = A.expand(row.column(2)[0].as_py()), np.cumsum(size)
            for i in mine:
                yield int(ids[i]), flat[end[i] - size[i] : end[i]]


def shingles(lines: list[str], chars: int, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of each line and the lines' offsets among them; short lines are one shingle.

    Hashes that are not ``mixed`` tell shingles apart, but their bits are not even.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    sums = k.prefix(codes + k.U64(1))
    if size.min(initial=chars) < chars:
        count = np.maximum(size - chars + 1, 1)
        row = np.repeat(np.arange(len(size)), count)
        first = (end - size)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return k.spans(sums, first, first + np.minimum(size, chars)[row]), np.concatenate([[0], np.cumsum(count)])
    inside = np.ones(max(len(codes) - chars + 1, 0), bool)
    for i in range(1, chars):  # shingles that reach into the next line
        inside[end[:-1] - i] = False
    grams = (sums[chars:] - sums[:-chars]) * k.powers(len(sums))[1][: len(sums) - chars]
    grams = grams[inside]
    return k.mix(grams) if mixed else grams, np.concatenate([[0], np.cumsum(size - chars + 1)])


def shingle_sets(lines: list[str], chars: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    grams, bounds = shingles(lines, chars)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x = np.sort(grams[a:b])
        out.append(x[np.flatnonzero(np.diff(x, prepend=~x[:1]))])
    return out


def band_keys(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int, factors: np.ndarray) -> np.ndarray:
    """(line, band) keys from least values of permuted shingle hashes; odd factors permute 32-bit hashes."""
    low = ((grams ^ (grams >> k.U64(32))) * k.U64(0x9E3779B97F4A7C15) >> k.U64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, bands), np.uint64)
    for band in range(bands):
        key = np.full(len(bounds) - 1, band + 1, np.uint64)
        for j in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat(low * factors[j], bounds[:-1])
            key = key * k.U64(0x9E3779B97F4A7C15) + least
        out[:, band] = k.mix(key)
    return out


def word_keys(lines: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Line ids and hashes of each line and of what is left without one of its words: lines that differ in one word share one."""
    raw = [x.encode() for _, x in lines]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, bounds = k.words(data, offsets)
    sums = k.prefix(k.word_hashes(data, starts, ends))
    down = k.powers(len(sums))[1]
    word = np.flatnonzero(ends - starts <= SHORT_EDIT)
    line = np.searchsorted(bounds, word, "right") - 1
    a, b = bounds[line], bounds[line + 1]
    # The words after the one left out move up by one.
    rest = k.mix((sums[word] - sums[a] + (sums[b] - sums[word + 1]) * down[1]) * down[a])
    nodes = np.array([i for i, _ in lines], np.int64)
    groups, of = group_keys(sums, starts, ends, bounds)
    return np.concatenate([nodes, nodes[line], nodes[of]]), np.concatenate([k.spans(sums, bounds[:-1], bounds[1:]), rest, groups])


def group_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of any two of the ``GROUPS`` parts that the words of a line make up, by their numbers: edits inside up to three words leave two parts as they are."""
    count, letters = np.diff(bounds), np.concatenate([[0], np.cumsum(ends - starts)])
    cuts = bounds[:-1, None] + count[:, None] * np.arange(GROUPS + 1) // GROUPS
    hashes = k.spans(sums, cuts[:, :-1].ravel(), cuts[:, 1:].ravel()).reshape(-1, GROUPS)
    size = letters[cuts[:, 1:]] - letters[cuts[:, :-1]]
    keys, lines = [], []
    for n, (i, j) in enumerate(combinations(range(GROUPS), 2), 1):
        some = np.flatnonzero((size[:, i] > 0) & (size[:, j] > 0) & (size[:, i] + size[:, j] >= GROUP_LETTERS))
        keys.append(k.mix(hashes[some, i] * k.U64(0x9E3779B97F4A7C15) + hashes[some, j] + k.U64(n)))
        lines.append(some)
    return np.concatenate(keys), np.concatenate(lines)


def _bands(docs: DataFrame, least: int, chars: int, n: int) -> DataFrame:
    """Blobs by band or word key: keys and line ids; the last bit of a key is 1 under the rule of short lines."""
    rules = [(chars, BANDS, ROWS, _FACTORS, lambda x: len(x) >= LONG), (SHORT_CHARS, SHORT_BANDS, SHORT_ROWS, _SHORT_FACTORS, lambda x: len(x) < SHORT)]

    def run(batches):
        for found in fresh_lines(batches, least):
            ids, keys = [], []
            for kind, (width, bands, rows, factors, judged) in enumerate(rules):
                mine = [x for x in found.items() if judged(x[1])]
                for at in range(0, len(mine), AT_ONCE):
                    part = mine[at : at + AT_ONCE]
                    grams, bounds = shingles([x for _, x in part], width, mixed=False)
                    keys.append(band_keys(grams, bounds, bands, rows, factors).ravel() & ~k.U64(1) | k.U64(kind))
                    ids.append(np.repeat(np.array([i for i, _ in part], np.int64), bands))
                    if kind:
                        nodes, near = word_keys(part)
                        keys.append(near | k.U64(1))
                        ids.append(nodes)
            if ids:
                ids, keys = np.concatenate(ids), np.concatenate(keys)
                yield from A.deal((keys >> k.U64(40)) % k.U64(n), [(keys, lambda x: A.squeeze(A.narrow(x, A.KEY))), (ids, A.squeeze)])

    return docs.select("text").mapInArrow(run, A.BLOB)


def _clusters(bands: DataFrame) -> DataFrame:
    """(leader, node): who shares a key; the last bit of a leader is the key's."""

    def run(key, table):
        keys, ids = A.gather(table, [lambda x: A.widen(A.expand(x), A.KEY), A.expand])
        order = np.argsort(keys)
        again = np.diff(keys[order], prepend=~keys[order][:1]) == 0
        again[:-1] |= again[1:].copy()
        order = order[again]  # keys that come once are most of all
        order = order[np.lexsort((ids[order], keys[order]))]
        keys, ids = keys[order], ids[order]
        fresh = (np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(ids, prepend=~ids[:1]) != 0)
        keys, ids = keys[fresh], ids[fresh]  # a line may have been passed on more than once
        cut = np.diff(keys, prepend=~keys[:1]) != 0
        group, at = np.cumsum(cut) - 1, np.flatnonzero(cut)
        many = np.bincount(group, minlength=1)[group] > 1
        leader = ids[at] & ~1 | (keys[at] & k.U64(1)).astype(np.int64)
        pairs = np.unique(np.stack([leader[group][many], ids[many]], axis=1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
        return pa.table({"leader": pa.array(pairs[:, 0].copy()), "node": pa.array(pairs[:, 1].copy())})

    return bands.groupBy("bucket").applyInArrow(run, "leader bigint, node bigint").distinct()


def _members(texts: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """Blobs by cluster task, as ``jaccard.member_blobs`` has them, with the bytes of the lines."""

    def run(key, left, right):
        want = J.wanted_by(right)
        rows, raws = [], []
        for node, raw in _wanted_lines(left, want) if want else ():
            for leader, one, two, side in want[node]:
                rows.append((leader, one, two, side, node, len(raw), len(raw)))
                raws.append(raw)
        return J.member_blobs(rows, raws, n)

    return texts.groupBy("bucket").cogroup(tasks.groupBy("bucket")).applyInArrow(run, A.BLOB)


def _links(blobs: DataFrame, chars: int, percent: int) -> DataFrame:
    """(a, b): pairs that join the lines of each cluster task that link by their cluster's rule."""

    def run(key, table):
        pairs = []
        for tasks in _blocks(J.each_task(table)):
            for short in (False, True):
                mine = [t for t in tasks if bool(t[0] & 1) == short]
                sets = iter(shingle_sets([x.tobytes().decode() for t in mine for x in t[4]], SHORT_CHARS if short else chars) if mine else ())
                for _, nodes, _, sides, raws in mine:
                    found = [next(sets) for _ in raws]
                    links = J.link_cluster(found, sides, SHORT_PERCENT, SHORT_EDIT) if short else J.link_cluster(found, sides, percent)
                    pairs += [(nodes[i], nodes[j]) for i, j in links]
            pa.default_memory_pool().release_unused()
        return stars(pairs)

    return blobs.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def _blocks(tasks, most: int = 1 << 20):
    """Lists of tasks of about ``most`` bytes."""
    block, held = [], 0
    for task in tasks:
        block.append(task)
        held += sum(map(len, task[4]))
        if held > most:
            yield block
            block, held = [], 0
    if block:
        yield block


def dropped_lines(docs: DataFrame, least: int = LEAST, chars: int = CHARS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, node, gone): the line numbers that go, for each document (id and text hash) that loses any."""
    n = A.buckets_for(docs)
    noded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    clusters = materialize(_clusters(_bands(noded, least, chars, n)), "bands")
    texts = lambda tasks: _texts(noded, least, n, J.marks(tasks))
    roots = J.linked_roots(clusters, lambda tasks: _links(_members(texts(tasks), tasks.withColumn("bucket", F.pmod("node", F.lit(n)).cast("int")), n), chars, percent))
    discard(clusters)
    seen = materialize(_occurrences(noded), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "line_no")
    lines = seen.withColumn("at", order).groupBy("line_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = lines.join(roots, lines["line_id"] == roots["node"], "left").select("line_id", "first", "n", "root")
    alone = placed.where("root is null and n > 1").select("line_id", F.col("first").alias("stays"))
    # One component may hold a third of all lines: its first line is found by partial minima and met by salted keys.
    grouped = placed.where("root is not null").withColumn("salt", F.pmod("line_id", F.lit(SALTS)))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("stays")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    judged = alone.unionByName(grouped.join(firsts, ["root", "salt"]).select("line_id", "stays"))
    gone = seen.withColumn("at", order).join(judged, "line_id").where(~F.col("at").eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "node").agg(F.collect_set("line_no").alias("gone"))


def drop_lines(docs: DataFrame, least: int = LEAST, chars: int = CHARS, percent: int = PERCENT, count: str | None = "n_lines_gone") -> DataFrame:
    """``docs`` with texts that have lost their repeated lines, n_chars made to fit where it is there, and the lines gone.

    These are counted in a column ``count``, which takes the place of one of that name; None: no such column.
    """
    gone_id, gone_node, node, lost = unused(docs, "gone_id", "gone_node", "node", "lost")
    gone = dropped_lines(docs, least, chars, percent).select(F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node), F.col("gone").alias(lost))
    noded = docs.withColumn(node, F.xxhash64(F.coalesce("text", F.lit(""))))
    both = noded.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(node) == F.col(gone_node)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(lost, i)), "\n")
    same = F.col(lost).isNull()
    out = both.withColumn("text", F.when(same, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    found = [] if count is None else [F.when(same, F.lit(0)).otherwise(F.size(lost)).cast("long").alias(count)]
    return out.select(*[quoted(c) for c in docs.columns if c != count], *found)


def op3(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs)
    kept = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", kept.cast("long").alias("n_lines_kept"), F.col("n_lines_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
