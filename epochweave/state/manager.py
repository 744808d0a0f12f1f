"""The state over periods: batches of writes, reads, commits with roots, rotation, versions on disk.

Layers are logs of tables, so a batch, a commit or a rotation writes what has
changed and not what stands, and roots follow from the changes (``merkle.Index``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.functions.keccak import EMPTY
from epochweave.session import brief_shuffles, children, delete, materialize, shared_dir
from epochweave.state import keys, layers, merkle

ROW = "kind string, address binary, suffix binary, space string, key binary, raw_key binary, value binary, is_tombstone boolean, gone boolean, seq int"
_SEEN = ["kind", "address", "suffix", "space", "key", "raw_key", "value", "is_tombstone"]
#: Tables of a layer before they are made one.
MOST_TABLES = 8
_VERSION = "version bigint, height bigint, batch bigint, meta string"
NAMES = {layers.DELTA: "delta", layers.INTERMEDIATE: "intermediate", layers.SNAPSHOT: "snapshot"}
Write = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class CommitRoot:
    """Roots at a commit, before any rotation, and their combination."""

    height: int
    snapshot_root: bytes
    intermediate_root: bytes
    delta_root: bytes
    delta_padding: bytes

    @property
    def state_root_hash(self) -> bytes:
        return merkle.state_root(self.snapshot_root, self.intermediate_root, self.delta_root)


class StateStore(Protocol):
    """Where versions of a state are kept. ``write`` puts a table where a version can name it."""

    def write(self, df: DataFrame, name: str) -> DataFrame: ...

    def save_latest(self, state: LayeredState) -> None: ...

    def load_latest(self, spark: SparkSession) -> LayeredState | None: ...


class Layer:
    """One layer: a log of tables of rows, of which the last one of a key counts, and the index of its trie.

    A row that is ``gone`` says that the layer knows its key no more. Rows
    since the last ``root`` are put into the index then, all at once.
    """

    def __init__(self, spark: SparkSession, write: Write, name: str, tables: list[DataFrame] = (), seq: int = 0, index: merkle.Index | None = None):
        self.spark, self.write, self.name, self.tables, self.seq = spark, write, name, list(tables), seq
        self.index = index or merkle.Index(spark, write=lambda df: write(df, "index"))
        self.pending: list[DataFrame] = []

    def copy(self) -> Layer:
        i = self.index
        out = Layer(self.spark, self.write, self.name, self.tables, self.seq, merkle.Index(self.spark, i.hash_name, i.tables, i.at, i.root, i.write))
        out.pending = list(self.pending)
        return out

    @property
    def rows(self) -> DataFrame:
        """The rows of the keys that the layer knows."""
        if not self.tables:
            return self.spark.createDataFrame([], ROW).select(*_SEEN)
        if len(self.tables) == 1:
            return self.tables[0].where("not gone").select(*_SEEN)
        rest = [c for c in (*_SEEN, "gone") if c != "key"]
        last = reduce(DataFrame.unionByName, self.tables).groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
        return last.select("key", "r.*").where("not gone").select(*_SEEN)

    def add(self, rows: DataFrame) -> None:
        """Puts rows (with ``gone``, one a key) on top: only they are written."""
        table = self.write(rows.select(*_SEEN, "gone", F.lit(self.seq).alias("seq")), self.name)
        self.tables.append(table)
        self.pending.append(table)
        self.seq += 1

    def root(self) -> bytes:
        """The root of the layer's map, at the cost of what has changed since the last time."""
        if self.pending:
            live = F.when(~F.col("is_tombstone"), F.col("value"))
            changed = reduce(DataFrame.unionByName, self.pending).groupBy("raw_key").agg(F.max_by(F.struct(live.alias("value"), "gone"), "seq").alias("r"))
            self.pending = []
            self.index.update(changed.select("raw_key", "r.*"), key="raw_key", gone="gone")
        return self.index.root

    def compact(self) -> None:
        """One table in the place of a log of more than ``MOST_TABLES``, in the order of keys."""
        if len(self.tables) > MOST_TABLES:
            self.root()
            whole = self.rows.withColumn("gone", F.lit(False)).withColumn("seq", F.lit(self.seq))
            self.tables, self.seq = [self.write(whole.repartitionByRange("key").sortWithinPartitions("key"), self.name)], self.seq + 1


class LayeredState:
    """Three layers of key-value rows.

    Writes come in batches (a DataFrame of kind, address, suffix, space, value
    and an order column); each batch is one table on top of the delta. Layers
    move on at a period's end without being written again: the delta as it is,
    the intermediate layer's rows on top of the snapshot's. ``batch`` is the
    last micro-batch of a stream that the state holds, -1 for none; ``version``
    counts the versions that were saved.
    """

    def __init__(self, spark: SparkSession, period: int, write: Write = materialize, height: int = 0, delta_padding: bytes | None = None, intermediate_padding: bytes | None = None, batch: int = -1, version: int = 0, parts: dict[int, Layer] | None = None):
        self.spark, self.period, self.write, self.height, self.batch, self.version = spark, period, write, height, batch, version
        self.layers = parts or {n: Layer(spark, write, name) for n, name in NAMES.items()}
        self.delta_padding = delta_padding or keys.period_padding()
        self.intermediate_padding = intermediate_padding or keys.period_padding()

    @classmethod
    def from_snapshot(cls, spark: SparkSession, period: int, snapshot: DataFrame, write: Write = materialize) -> LayeredState:
        """A state that starts from (kind, address, suffix, space, value) rows; the padding hangs on their root."""
        state = cls(spark, period, write)
        key = _canonical()
        rows = snapshot.select("kind", "address", "suffix", "space", key.alias("key"), key.alias("raw_key"), "value", F.lit(False).alias("is_tombstone"), F.lit(False).alias("gone"))
        state.layers[layers.SNAPSHOT].add(rows)
        state.delta_padding = keys.period_padding(state.snapshot_root, EMPTY)
        return state

    def copy(self) -> LayeredState:
        return LayeredState(self.spark, self.period, self.write, self.height, self.delta_padding, self.intermediate_padding, self.batch, self.version, {n: x.copy() for n, x in self.layers.items()})

    @property
    def snapshot_root(self) -> bytes:
        return self.layers[layers.SNAPSHOT].root()

    @property
    def intermediate_root(self) -> bytes:
        return self.layers[layers.INTERMEDIATE].root()

    @property
    def rows(self) -> DataFrame:
        """What all layers know, a row per layer and key."""
        return reduce(DataFrame.unionByName, [x.rows.withColumn("layer", F.lit(n)) for n, x in self.layers.items()])

    def cold_roots(self) -> dict[int, bytes]:
        """The root of each layer from its rows alone, to check its index."""
        out = {}
        for n, x in self.layers.items():
            found = merkle.merkle_root(x.rows.select("raw_key", F.when(~F.col("is_tombstone"), F.col("value")).alias("value")), key="raw_key").first()
            out[n] = bytes(found["root"]) if found else EMPTY
        return out

    def set(self, ops: DataFrame, order: str = "seq") -> None:
        """Puts a batch into the delta: the last write of a key wins, an empty value is a tombstone."""
        last = layers.latest(ops.withColumn("key", _canonical()), "key", order)
        keyed = keys.with_delta_keys(last, self.delta_padding)
        stone = F.col("value").isNull() | (F.length("value") == 0)
        fresh = keyed.select("kind", "address", "suffix", "space", "key", F.col("delta_key").alias("raw_key"), "value", stone.alias("is_tombstone"), F.lit(False).alias("gone"))
        self.layers[layers.DELTA].add(fresh.withColumn("value", F.when(~F.col("is_tombstone"), F.col("value"))))

    def get(self, wanted: DataFrame) -> DataFrame:
        """(key, value) of live keys among (kind, address, suffix, space) rows."""
        return layers.get(self.rows, wanted.select(_canonical().alias("key")))

    def _matching(self, kind: str, address: bytes, suffix: bytes | None, space: str, compat: bool) -> DataFrame:
        """Rows under a prefix. With ``compat`` each layer is matched in its own encoding, so a part of a storage key misses delta and intermediate."""
        one = self.spark.createDataFrame([(kind, address, suffix, space)], "kind string, address binary, suffix binary, space string")
        canonical = bytes(one.select(_canonical()).first()[0])
        under = layers.in_prefix(F.col("key"), canonical)
        if not compat or kind == "address_prefix":
            return self.rows.where(under)
        raw = {}
        for layer, padding in ((layers.DELTA, self.delta_padding), (layers.INTERMEDIATE, self.intermediate_padding)):
            raw[layer] = bytes(keys.with_delta_keys(one, padding).select("delta_key").first()[0])
        test = (F.col("layer") == layers.SNAPSHOT) & under
        for layer, prefix in raw.items():
            test = test | ((F.col("layer") == layer) & layers.in_prefix(F.col("raw_key"), prefix))
        return self.rows.where(test)

    def get_all_by_prefix(self, kind: str, address: bytes, suffix: bytes | None = None, space: str = "native", compat: bool = True) -> DataFrame:
        """(key, value) of what reads see under a prefix."""
        return layers.visible(self._matching(kind, address, suffix, space, compat)).select("key", "value")

    def delete_all_by_prefix(self, kind: str, address: bytes, suffix: bytes | None = None, space: str = "native", compat: bool = True) -> DataFrame:
        """Deletes under a prefix and returns the (key, value) that were seen there.

        Delta rows go; what is seen below gets tombstones. Address prefixes and
        empty keys encode to nothing in the delta, so with ``compat`` they wipe all of it.
        """
        hit = self._matching(kind, address, suffix, space, compat)
        removed = materialize(layers.visible(hit).select("key", "value"), "removed")
        below = hit.where(F.col("layer") != layers.DELTA)
        named = below.join(layers.visible(below).select("key"), "key", "left_semi").dropDuplicates(["key"]).select("kind", "address", "suffix", "space", "key")
        stones = keys.with_delta_keys(named, self.delta_padding).select("kind", "address", "suffix", "space", "key", F.col("delta_key").alias("raw_key"), F.lit(None).cast("binary").alias("value"), F.lit(True).alias("is_tombstone"), F.lit(False).alias("gone"))
        stones = materialize(stones, "stones")
        if compat and kind in ("address_prefix", "empty"):
            self.layers[layers.DELTA] = Layer(self.spark, self.write, NAMES[layers.DELTA])
        else:
            lost = hit.where(F.col("layer") == layers.DELTA).join(stones.select("key"), "key", "left_anti")
            stones = stones.unionByName(lost.select(*_SEEN).withColumn("gone", F.lit(True)))
        self.layers[layers.DELTA].add(stones)
        return removed

    def commit(self) -> CommitRoot:
        """Roots as they stand; then the height rises and, at a period's end, the layers move on."""
        delta = self.layers[layers.DELTA]
        root = CommitRoot(self.height, self.snapshot_root, self.intermediate_root, delta.root(), self.delta_padding)
        delta.compact()
        self.height += 1
        if layers.is_boundary(self.height, self.period):
            self._rotate(root.delta_root)
        return root

    def _rotate(self, delta_root: bytes) -> None:
        snapshot, moved = self.layers[layers.SNAPSHOT], self.layers[layers.INTERMEDIATE]
        if moved.tables:
            snapshot.add(moved.rows.select("kind", "address", "suffix", "space", "key", F.col("key").alias("raw_key"), "value", F.lit(False).alias("is_tombstone"), F.col("is_tombstone").alias("gone")))
            snapshot.compact()
        self.layers[layers.INTERMEDIATE] = self.layers[layers.DELTA]
        self.layers[layers.INTERMEDIATE].name = NAMES[layers.INTERMEDIATE]
        self.layers[layers.DELTA] = Layer(self.spark, self.write, NAMES[layers.DELTA])
        self.intermediate_padding, self.delta_padding = self.delta_padding, keys.period_padding(self.snapshot_root, delta_root)


def _canonical():
    return keys.canonical_key(F.col("kind"), F.col("address"), F.col("suffix"), F.col("space"))


class MemoryStore:
    """Keeps the last state of a session; its tables lie in the session's shared folder."""

    def __init__(self):
        self._state: LayeredState | None = None

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name)

    def save_latest(self, state: LayeredState) -> None:
        self._state = state.copy()

    def load_latest(self, spark: SparkSession) -> LayeredState | None:
        return self._state and self._state.copy()


class ParquetStore:
    """Versions as manifests that name the tables of each layer and of its index.

    Tables are written once, when their rows come, under ``tables``; to save a
    version writes its manifest alone, one row in a folder of its own, so a
    version counts only when it is whole. Tables that none of the last
    ``keep`` versions names are deleted after a save: a job that died before
    its save leaves tables behind that the next save takes away. One writer at
    a time.
    """

    def __init__(self, path: str, keep: int = 2):
        self.path, self.keep = path.rstrip("/"), keep

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/tables/{name}-{uuid.uuid4().hex}"
        with brief_shuffles(df.sparkSession):
            df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out.scratch = path
        return out

    def _name(self, table: DataFrame) -> str:
        return table.scratch.rsplit("/", 1)[-1]

    def save_latest(self, state: LayeredState) -> None:
        parts = {}
        for n, x in state.layers.items():
            x.root()
            parts[n] = {"tables": [self._name(t) for t in x.tables], "seq": x.seq, "index": [self._name(t) for t in x.index.tables], "at": x.index.at, "root": x.index.root.hex()}
        state.version += 1
        meta = {"period": state.period, "height": state.height, "delta_padding": state.delta_padding.hex(), "intermediate_padding": state.intermediate_padding.hex(), "batch": state.batch, "layers": parts}
        one = state.spark.createDataFrame([(state.version, state.height, state.batch, json.dumps(meta))], _VERSION).coalesce(1)
        one.write.parquet(f"{self.path}/versions/{state.version:012d}-{uuid.uuid4().hex}")
        self._collect(state.spark)

    def _versions(self, spark: SparkSession) -> list:
        """(version, height, batch, meta, file) of all manifests, the latest first."""
        from pyspark.errors import AnalysisException

        try:
            return spark.read.schema(_VERSION).parquet(f"{self.path}/versions/*").select("*", F.input_file_name().alias("file")).orderBy(F.desc("version"), F.desc("height"), F.desc("batch"), F.desc("file")).collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _collect(self, spark: SparkSession) -> None:
        """Deletes manifests before the last ``keep`` and tables that these do not name; a manifest goes before its tables."""
        found = self._versions(spark)
        named = {t for v in found[: self.keep] for x in json.loads(v["meta"])["layers"].values() for t in (*x["tables"], *x["index"])}
        for v in found[self.keep :]:
            delete(spark, v["file"].rsplit("/", 1)[0])
        for name in children(spark, f"{self.path}/tables"):
            if name not in named:
                delete(spark, f"{self.path}/tables/{name}")

    def load_latest(self, spark: SparkSession) -> LayeredState | None:
        found = self._versions(spark)
        if not found:
            return None
        meta = json.loads(found[0]["meta"])

        def table(name: str, schema: str) -> DataFrame:
            out = spark.read.schema(schema).parquet(f"{self.path}/tables/{name}")
            out.scratch = f"{self.path}/tables/{name}"
            return out

        parts = {}
        for n, x in meta["layers"].items():
            index = merkle.Index(spark, tables=[table(t, merkle.NODE) for t in x["index"]], at=x["at"], top=bytes.fromhex(x["root"]), write=lambda df: self.write(df, "index"))
            parts[int(n)] = Layer(spark, self.write, NAMES[int(n)], [table(t, ROW) for t in x["tables"]], x["seq"], index)
        return LayeredState(spark, meta["period"], self.write, meta["height"], bytes.fromhex(meta["delta_padding"]), bytes.fromhex(meta["intermediate_padding"]), meta["batch"], found[0]["version"], parts)


class StateManager:
    """Loads the latest version, passes on reads and writes, and saves at each commit."""

    def __init__(self, spark: SparkSession, store: StateStore, period: int = 2000):
        self.store = store
        self.state = store.load_latest(spark) or LayeredState(spark, period, store.write)

    def __getattr__(self, name: str):
        return getattr(self.state, name)

    def commit(self, batch: int | None = None) -> CommitRoot:
        """Commit and save; ``batch`` is the micro-batch that the version holds."""
        root = self.state.commit()
        self.state.batch = self.state.batch if batch is None else batch
        self.store.save_latest(self.state)
        return root


def default_store(spark: SparkSession) -> ParquetStore:
    return ParquetStore(f"{shared_dir(spark)}/state")


def describe(root: CommitRoot) -> dict:
    return {k: v.hex() if isinstance(v, bytes) else v for k, v in asdict(root).items()} | {"state_root_hash": root.state_root_hash.hex()}
