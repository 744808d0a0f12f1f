"""Merkle roots of sorted key-value maps, cold and incremental.

A node of the trie is a path of nibbles where keys part (or end), with up to
16 kids below and, where a key ends there, that key. A kid is a key with its
value or the core of a subtree; its path up to its parent is hashed on top of
its core, so a core hangs on nothing above it.

Cold: items (keys, later subtrees) are sorted by ranges. Each task makes the
nodes that lie wholly within its range, all but those on its two edges, and
passes on what hangs on the edges as items of the next round. A round leaves
some dozens of items a task, whatever prefixes the keys share, so two or three
rounds make any map. Every node is written as a row with its kids.

Incremental (``Index``): the nodes on the way of a changed key are found by
joins on their paths. Their other kids, as they stand, and the changed keys
make up a small map of items, whose nodes replace them: work follows the
number of changes times the depth. An index is a log of such tables; the last
row of a path counts. The hash is a parameter: Keccak-256, or SHA-256 to
compare with SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.functions.keccak import keccak, keccak_many
from epochweave.session import materialize

#: Items that a task folds at most on average.
CROWD = 20_000
#: Tables of an index before they are made one.
MOST_TABLES = 8


def _sha_many(messages: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(m).digest() for m in messages]


HASHES = {"keccak": keccak_many, "sha256": _sha_many}
_KID = "path string, leaf boolean, core binary, value binary"
_ROW = f"path string, node boolean, leaf boolean, core binary, value binary, kids array<struct<{_KID.replace(' ', ':').replace(',:', ',')}>>"
NODE = f"path string, core binary, kids array<struct<{_KID.replace(' ', ':').replace(',:', ',')}>>, at int"


def path_bytes(path: str, depth: int) -> bytes:
    """Info byte and nibbles of a path that starts at ``depth``; the length is taken modulo 256 before 63."""
    lead, rest = (path[:1], path[1:]) if depth % 2 else ("", path)
    packed = (bytes.fromhex("0" + lead) if lead else b"") + bytes.fromhex(rest + "0" * (len(rest) % 2))
    return bytes([128 + 64 * (depth % 2) + len(path) % 256 % 63]) + packed


def node_message(children: dict[int, bytes], value: bytes | None, has_value: bool, null: bytes) -> bytes:
    """What a node hashes; a tombstone's value is the bare mark."""
    return b"n" + b"".join(children.get(i, null) for i in range(16)) + (b"v" + (value or b"") if has_value else b"")


def common(x: str, y: str) -> int:
    """Nibbles that two paths share at their start."""
    if y.startswith(x):
        return len(x)
    n = 0
    for a, b in zip(x, y, strict=False):
        if a != b:
            break
        n += 1
    return n


@dataclass
class Item:
    """A key (``leaf``) or a subtree, by its path. A core is None until it is hashed; a null value of a key is a tombstone."""

    path: str
    leaf: bool
    core: bytes | None
    value: bytes | None
    kids: list[Item] = field(default_factory=list)
    height: int = 0

    def row(self, node: bool) -> dict:
        return {"path": self.path, "node": node, "leaf": self.leaf, "core": self.core, "value": self.value, "kids": [{"path": k.path, "leaf": k.leaf, "core": k.core, "value": k.value} for k in self.kids] if node else None}


def branches(items: list[Item], whole: bool) -> tuple[list[Item], list[Item]]:
    """(nodes, items that are passed on) of sorted items: the trie's nodes, or those of them that no item outside can belong to.

    Such a node has neither the first nor the last item below it. With
    ``whole`` there is nothing outside, and the node of the empty path is made
    whatever it has below.
    """
    made: list[Item] = []
    passed: list[Item] = []
    edge: list[tuple[int, int, list[Item]]] = []  # depth, first item, kids of the open nodes
    for i, item in enumerate(items):
        low = common(item.path, items[i + 1].path) if i + 1 < len(items) else (0 if whole else -1)
        now, first = item, i
        while edge and edge[-1][0] > low:
            depth, start, kids = edge.pop()
            if now is not None:
                kids.append(now)
            if whole or (start > 0 and low >= 0):
                now, first = Item(kids[0].path[:depth], False, None, None, kids, 1 + max(k.height for k in kids)), start
                made.append(now)
            else:
                passed += kids
                now, first = None, start
        if low < 0:
            passed += [now] if now is not None else []
        elif edge and edge[-1][0] == low:
            if now is not None:
                edge[-1][2].append(now)
        else:
            edge.append((low, first, [now] if now is not None else []))
    if whole and items:
        _, _, kids = edge.pop()
        made.append(Item("", False, None, None, kids, 1 + max(k.height for k in kids)))
    return made, passed


def hash_nodes(nodes: list[Item], many: Callable) -> None:
    """Cores of nodes and of the keys below them, a batch for each height."""
    null = many([b""])[0]
    keys = list({id(k): k for n in nodes for k in n.kids if k.leaf and k.core is None}.values())
    hash_keys(keys, many, null)
    levels: dict[int, list[Item]] = {}
    for n in nodes:
        levels.setdefault(n.height, []).append(n)
    for height in sorted(levels):
        level = levels[height]
        below = [(k, len(n.path) + 1) for n in level for k in n.kids if len(k.path) > len(n.path) + 1]
        wrapped = dict(zip(((id(k), at) for k, at in below), many([path_bytes(k.path[at:], at) + k.core for k, at in below]), strict=True))
        messages = []
        for n in level:
            at = len(n.path)
            own = next((k for k in n.kids if len(k.path) == at), None)
            children = {int(k.path[at], 16): wrapped.get((id(k), at + 1), k.core) for k in n.kids if len(k.path) > at}
            messages.append(node_message(children, own.value if own else None, own is not None, null))
        for n, core in zip(level, many(messages), strict=True):
            n.core = core


def hash_keys(keys: list[Item], many: Callable, null: bytes) -> None:
    for k, core in zip(keys, many([node_message({}, k.value, True, null) for k in keys]), strict=True):
        k.core = core


def root(entries: dict[bytes, bytes | None], hash_name: str = "keccak") -> bytes:
    """The root of a small map in plain Python; None is a tombstone."""
    many = HASHES[hash_name]
    made, _ = branches([Item(k.hex(), True, None, v) for k, v in sorted(entries.items())], True)
    hash_nodes(made, many)
    return made[-1].core if made else many([b""])[0]


def _items(rows: pa.Table) -> list[Item]:
    return [Item(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("path", "leaf", "core", "value")), strict=True)]


def _round(items: DataFrame, by: list[str], parts: int, hash_name: str) -> DataFrame:
    """``_ROW``s of one round over ``items``; with one part, all nodes."""
    kinds = [(c, items.schema[c].dataType) for c in by]
    prefix = "".join(f"{c} {t.simpleString()}, " for c, t in kinds)
    columns = [*by, "path", "node", "leaf", "core", "value", "kids"]
    dealt = items.repartitionByRange(parts, *by, "path") if parts > 1 else items.coalesce(1)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(items.sparkSession.createDataFrame([], prefix + _ROW).schema)

    def run(batches):
        many = HASHES[hash_name]
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        found, groups = _items(rows), list(zip(*(rows.column(c).to_pylist() for c in by), strict=True)) if by else [()] * rows.num_rows
        cuts = [0, *(i for i in range(1, len(found)) if groups[i] != groups[i - 1]), len(found)]
        nodes: list[tuple[tuple, Item]] = []
        passed: list[tuple[tuple, Item]] = []
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            # A group that does not touch the range's ends lies wholly within it.
            made, rest = branches(found[a:b], parts == 1 or 0 < n < len(cuts) - 2)
            nodes += [(groups[a], x) for x in made]
            passed += [(groups[a], x) for x in rest]
        hash_nodes([x for _, x in nodes], many)
        hash_keys([x for _, x in passed if x.leaf and x.core is None], many, many([b""])[0])
        out = [dict(zip(by, g, strict=True)) | x.row(node) for of, node in ((nodes, True), (passed, False)) for g, x in of]
        for at in range(0, len(out), 5000):
            yield pa.RecordBatch.from_pylist(out[at : at + 5000], schema)

    return dealt.sortWithinPartitions(*by, "path").mapInArrow(run, prefix + _ROW).select(*columns)


def build(items: DataFrame, hash_name: str = "keccak", by: list[str] = (), crowd: int | None = None) -> list[DataFrame]:
    """Tables whose rows with ``node`` are all nodes over ``items`` (*by, path, leaf, core, value), for each group; paths of items are not repeated."""
    by, tables, crowd = list(by), [], crowd or CROWD
    count = items.count()
    while count:
        parts = -(-count // crowd)
        made = materialize(_round(items, by, parts, hash_name), "nodes")
        tables.append(made)
        if parts == 1:
            break
        items = made.where("not node").select(*by, "path", "leaf", "core", "value")
        before, count = count, items.count()
        if count > before // 2:  # ranges of few items: take larger ones
            crowd *= 2
    return tables


def key_items(kv: DataFrame, key: str = "key", value: str = "value", by: list[str] = ()) -> DataFrame:
    """Items of a map of binary keys; a null value is a tombstone."""
    return kv.select(*by, F.lower(F.hex(key)).alias("path"), F.lit(True).alias("leaf"), F.lit(None).cast("binary").alias("core"), F.col(value).cast("binary").alias("value"))


def merkle_root(kv: DataFrame, key: str = "key", value: str = "value", hash_name: str = "keccak", by: list[str] = (), crowd: int | None = None) -> DataFrame:
    """(*by, root): the root of each group's map of binary keys; a null value is a tombstone. An empty map has no row."""
    tables = build(key_items(kv, key, value, by), hash_name, by, crowd)
    if not tables:
        return kv.select(*by, F.lit(None).cast("binary").alias("root")).limit(0)
    return reduce(DataFrame.unionByName, [t.where("node and path = ''").select(*by, F.col("core").alias("root")) for t in tables])


class Index:
    """All nodes of a map's trie, as a log of tables: the root without reading the map, and changes at the cost of their paths.

    ``write`` puts a table of ``NODE`` rows (path, core, kids, at) into storage
    and returns it read back. A row without kids says that its path is no node
    any more; of several rows of a path that with the greatest ``at`` counts.
    """

    def __init__(self, spark: SparkSession, hash_name: str = "keccak", tables: list[DataFrame] = (), at: int = 0, top: bytes | None = None, write: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.hash_name, self.tables, self.at = spark, hash_name, list(tables), at
        self.write = write or (lambda df: materialize(df, "index"))
        self.root = top or HASHES[hash_name]([b""])[0]

    @classmethod
    def of(cls, kv: DataFrame, key: str = "key", value: str = "value", hash_name: str = "keccak", write: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        index = cls(kv.sparkSession, hash_name, write=write)
        index._add(key_items(kv, key, value), None)
        return index

    @property
    def rows(self) -> DataFrame:
        """Every row of the log."""
        return reduce(DataFrame.unionByName, self.tables)

    def nodes(self) -> DataFrame:
        """(path, core, kids, at) of the nodes as they are."""
        if len(self.tables) == 1:
            return self.tables[0].where(F.col("kids").isNotNull())
        last = self.rows.groupBy("path").agg(F.max_by(F.struct("core", "kids"), "at").alias("n"), F.max("at").alias("at"))
        return last.select("path", "n.*", "at").where(F.col("kids").isNotNull())

    def _add(self, items: DataFrame, gone: DataFrame | None) -> int:
        """Puts the nodes over ``items`` into the log and takes out the paths of ``gone`` that are none of them; the number of new nodes."""
        made = build(items, self.hash_name)
        fresh = [t.where("node").select("path", "core", "kids") for t in made]
        self.root = HASHES[self.hash_name]([b""])[0]
        if made:
            self.root = bytes(made[-1].where("node and path = ''").first()["core"])
        rows = fresh
        if gone is not None:
            left = gone if not fresh else gone.join(reduce(DataFrame.unionByName, fresh).select("path"), "path", "left_anti")
            rows = [*fresh, left.select("path", F.lit(None).cast("binary").alias("core"), F.lit(None).cast(dict(self._schema())["kids"]).alias("kids"))]
        if rows:
            self.tables.append(self.write(reduce(DataFrame.unionByName, rows).withColumn("at", F.lit(self.at))))
            self.at += 1
        return sum(t.count() for t in fresh)

    def _schema(self):
        return [(f.name, f.dataType) for f in self.spark.createDataFrame([], NODE).schema]

    def update(self, changed: DataFrame, key: str = "key", value: str = "value", gone: str | None = None) -> int:
        """Changes keys (one row each): new values, null for tombstones, or, where ``gone`` is true, no key any more. The number of nodes hashed anew."""
        removed = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
        asked = materialize(key_items(changed.withColumn("gone", removed), key, value, ["gone"]), "changed")
        if asked.isEmpty():
            return 0
        items = asked.where("not gone").drop("gone")
        if not self.tables:
            return self._add(items, None)
        sizes = sorted(r["n"] for r in self.rows.select(F.length("path").alias("n")).distinct().collect())  # at most one a nibble of the longest key
        wanted = asked.select(F.explode(F.expr(f"transform(filter(array({', '.join(map(str, sizes))}), n -> n <= length(path)), n -> substring(path, 1, n))")).alias("path")).distinct()
        hit = self.rows.join(wanted, "path", "left_semi")
        last = hit.groupBy("path").agg(F.max_by("kids", "at").alias("kids")).where(F.col("kids").isNotNull())
        dirty = materialize(last, "dirty")
        kids = dirty.select(F.explode("kids").alias("kid")).select("kid.*")
        still = kids.where("not leaf").join(dirty.select("path"), "path", "left_anti").unionByName(kids.where("leaf").join(asked.select("path"), "path", "left_anti"))
        hashed = self._add(still.select("path", "leaf", "core", "value").unionByName(items), dirty.select("path"))
        if len(self.tables) > MOST_TABLES:
            self.compact()
        return hashed

    def compact(self) -> None:
        """One table in the place of the log."""
        self.tables = [self.write(self.nodes().repartitionByRange("path").sortWithinPartitions("path"))]


def state_root(snapshot: bytes, intermediate: bytes, delta: bytes) -> bytes:
    return keccak(snapshot + intermediate + delta)
