"""Container files: readers and writers, as a Python data source and over ``binaryFile``."""

from __future__ import annotations

import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from epochweave.operators.packing import container_files, pack_containers
from epochweave.sources import packets, store

# Fixed values of the format.
MAGIC, VERSION = b"CFXPACK1", 1
HEADER, ENTRY = 24, 32
SUFFIX, SHARD_SUFFIX = ".cfxpack", ".cfxpkt"
EPOCHS = 2000
#: Payload bytes after which a container is closed.
TARGET = 104_857_600
#: Groups that are each a partition of their own when read; of more, neighbours of so many bytes are read by one task.
ALONE, TOGETHER = 128, 8 << 20
#: Packets that a task encodes or decodes, where their number is known.
PER_TASK = 16


def pack(groups: list[tuple[int, int, bytes]]) -> bytes:
    """A container of (start epoch, epoch count, packet) groups."""
    at = HEADER + ENTRY * len(groups)
    out = [MAGIC, VERSION.to_bytes(4, "little"), len(groups).to_bytes(4, "little"), EPOCHS.to_bytes(4, "little"), bytes(4)]
    for start, count, payload in groups:
        out += [v.to_bytes(8, "little") for v in (start, count, at, len(payload))]
        at += len(payload)
    return b"".join([*out, *(p for _, _, p in groups)])


def directory(data: bytes, whole: int | None = None) -> list[tuple[int, int, int, int]]:
    """(start epoch, epoch count, offset, length) of each group; ``whole`` is the file's size if only its head is given."""
    if len(data) < HEADER or data[:8] != MAGIC:
        raise ValueError("not a container")
    n, size = int.from_bytes(data[12:16], "little"), len(data) if whole is None else whole
    if len(data) < HEADER + ENTRY * n:
        raise ValueError("a directory ends too early")
    out = []
    for i in range(n):
        a = HEADER + ENTRY * i
        entry = tuple(int.from_bytes(data[a + 8 * j : a + 8 * j + 8], "little") for j in range(4))
        if entry[2] + entry[3] > size:
            raise ValueError("a payload is out of bounds")
        out.append(entry)
    return out


def inflate(name: str, data: bytes) -> bytes:
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def preferred(names: list[str]) -> list[str]:
    """One file per start epoch, compressed ones first, by start."""
    best: dict[int, str] = {}
    for name in sorted(names):
        m = re.search(rf"_(\d+)_(\d+){re.escape(SUFFIX)}(\.zst)?$", name)
        if m and (m[3] or int(m[1]) not in best):
            best[int(m[1])] = name
    if not best:
        raise FileNotFoundError("no container files")
    return [best[s] for s in sorted(best)]


SCHEMA = f"start_epoch bigint, {packets.BLOCK}"
#: Places of flag bytes: file, its group, the block's number there, the byte's place in the file (inflated, if compressed), the block's hash, the byte.
SITES = "path string, start_epoch bigint, index int, at bigint, hash binary, flags int"


def block_batch(start: int, payload: bytes, pos_from: int, schema: pa.Schema) -> pa.RecordBatch:
    """The block rows of a packet."""
    c = packets.decode_columns(payload, pos_from)[1]
    c["start_epoch"] = [start] * len(c["index"])
    if max(c["base_reward"], default=0) >> 63:
        c["base_reward"] = [Decimal(v) for v in c["base_reward"]]
    long = lambda f: pa.types.is_decimal(f.type) and c[f.name] and isinstance(c[f.name][0], int)
    arrays = [pa.array(c[f.name], pa.int64()).cast(f.type) if long(f) else pa.array(c[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(start_epoch, epochs, packet) of all containers in a folder of any store that Spark reads; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}*").load(path)
    best = container_files(files.select("path"), suffix=rf"{re.escape(SUFFIX)}(\.zst)?")
    if best.isEmpty():
        raise FileNotFoundError("no container files")
    return file_groups(files.join(best.select("path"), "path", "left_semi")).drop("path")


def file_groups(files: DataFrame) -> DataFrame:
    """(path, start_epoch, epochs, packet) of all groups of container files (path, content)."""

    def groups(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = inflate(name, value.as_py())
                for start, count, at, n in directory(data):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start]), pa.array([count]), pa.array([data[at : at + n]], pa.binary())], ["path", "start_epoch", "epochs", "packet"])

    return files.select("path", "content").mapInArrow(groups, "path string, start_epoch bigint, epochs bigint, packet binary")


def group_spans(files: DataFrame) -> DataFrame:
    """(path, start_epoch, epochs) of all groups of uncompressed container files (path, content), from their directories."""

    def spans(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = directory(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([s for s, *_ in found], pa.int64()), pa.array([c for _, c, *_ in found], pa.int64())], ["path", "start_epoch", "epochs"])

    return files.select("path", "content").mapInArrow(spans, "path string, start_epoch bigint, epochs bigint")


def read_containers(spark: SparkSession, path: str, pos_from: int) -> DataFrame:
    """Block rows of all containers in a folder; ``pos_from`` is required, as the schema hangs on it."""
    return decode_packets(read_groups(spark, path), pos_from)


def _dealt(df: DataFrame, key: str, n_packets: int | None) -> DataFrame:
    """``df`` by key, in tasks of some ``PER_TASK`` packets if their number is known: by bytes alone, Spark makes few tasks, and packets take long for their bytes."""
    return df.repartition(key) if n_packets is None else df.repartition(max(1, -(-n_packets // PER_TASK)), key)


def decode_packets(groups: DataFrame, pos_from: int, n_packets: int | None = None) -> DataFrame:
    """Block rows of (start_epoch, packet) rows; packets are dealt out first, so one large file feeds many tasks. ``n_packets`` is their number, if it is known."""
    schema = groups.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for start, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with packets.uncollected():
                    out = block_batch(start, value.as_py(), pos_from, arrow)
                yield out

    return _dealt(groups.select("start_epoch", "packet"), "start_epoch", n_packets).mapInArrow(run, schema)


def encode_packets(blocks: DataFrame, group: str, heads: DataFrame, n_packets: int | None = None) -> DataFrame:
    """(start_epoch, epochs, n_blocks, packet) of each group of block rows (with the columns of ``packets.BLOCK``).

    ``heads`` is (group, prev_last_hash, prev_last_deferred_state_root, first_block_number). A group is a bounded number of epochs.
    Where the blocks have a column pos_ref, its values and their views make up the packet's PoS lookup table. ``n_packets`` is the number of groups, if it is known.
    """
    schema = "start_epoch bigint, epochs bigint, n_blocks bigint, packet binary"

    def run(key, left, right):
        head = right.to_pylist()[0]
        if not left.num_rows:
            return pa.Table.from_pylist([], pa.schema([("start_epoch", pa.int64()), ("epochs", pa.int64()), ("n_blocks", pa.int64()), ("packet", pa.binary())]))
        with packets.uncollected():
            c = packets.of_table(left)
            data = packets.encode_columns(c, head["prev_last_hash"], head["prev_last_deferred_state_root"], head["first_block_number"], packets.pos_lookup(c))
            packets.verify(data)
        epochs = set(c["epoch"])
        return pa.Table.from_pylist([{"start_epoch": min(epochs), "epochs": len(epochs), "n_blocks": left.num_rows, "packet": data}])

    # Columns of its own, so that both sides may come from one table.
    heads = heads.select(*(F.col(c).alias(c) for c in heads.columns))
    return (blocks if n_packets is None else _dealt(blocks, group, n_packets)).groupBy(group).cogroup(heads.groupBy(group)).applyInArrow(run, schema)


def build_containers(groups: DataFrame, job: str = "job", target: int = TARGET, prefix: str = "epochs") -> DataFrame:
    """(name, content): packets of a job in order of start, each container closed by the packet that reaches ``target``.

    Containers are numbered from the packets' sizes alone; then each is built
    in a task of its own, which holds about ``target`` bytes.
    """
    sized = groups.select(job, "start_epoch", F.length("packet").cast("long").alias("bytes"))
    numbered = pack_containers(sized, job, "start_epoch", "bytes", target).select(job, "start_epoch", "container")

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["start_epoch", "epochs", "packet"]).sort_by("start_epoch")
        mine = [(start.as_py(), count.as_py(), payload.as_py()) for start, count, payload in zip(*rows.columns, strict=True)]
        first, last = mine[0][0], mine[-1][0] + mine[-1][1] - 1
        return pa.table({"name": pa.array([f"{prefix}_{first}_{last}{SUFFIX}"]), "content": pa.array([pack(mine)], pa.binary())})

    return groups.join(numbered, [job, "start_epoch"]).groupBy(job, "container").applyInArrow(run, "name string, content binary")


class GroupPartition(InputPartition):
    """Groups (start epoch, place, length) of a container, or, without any, a whole compressed file."""

    def __init__(self, name: str, groups: list[tuple[int, int, int]] = ()):
        self.name, self.groups = name, list(groups)


class _Reader(DataSourceReader):
    """One partition per group that may hold an epoch asked for, by options or by filters on ``epoch`` and ``start_epoch``.

    Beyond ``ALONE`` groups, a partition has neighbours of a file of up to
    ``TOGETHER`` bytes. Tasks read a packet at a time, by its place in the
    directory; with ``columns`` = ``flags``, its records alone, none of its
    transactions. A compressed file is inflated once, by its own task.
    """

    def __init__(self, options, schema):
        self.arrow = to_arrow_schema(schema)
        self.path, self.flags = options["path"], options.get("columns") == "flags"
        self.pos_from = 0 if self.flags else int(options["posFrom"])
        self.low, self.high = int(options.get("fromEpoch", 0)), int(options.get("toEpoch", 1 << 62))
        self.starts, self.compressed = (0, 1 << 62), options.get("compressed", "true") == "true"

    def pushFilters(self, filters):
        """Bounds of epochs choose groups; every filter is also left to Spark, as a group has other epochs, too."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) in (("epoch",), ("start_epoch",)) and isinstance(value, int):
                low = {GreaterThan: value + 1, GreaterThanOrEqual: value, EqualTo: value}.get(type(f), 0)
                high = {LessThan: value, LessThanOrEqual: value + 1, EqualTo: value + 1}.get(type(f), 1 << 62)
                if f.attribute == ("epoch",):
                    self.low, self.high = max(self.low, low), min(self.high, high)
                else:
                    self.starts = max(self.starts[0], low), min(self.starts[1], high)
            yield f

    def partitions(self):
        sizes = dict(store.listed(self.path))
        out, found = [], []
        for name in preferred([x for x in sizes if self.compressed or not x.endswith(".zst")]):
            if name.endswith(".zst"):
                out.append(GroupPartition(name))
                continue
            head = store.read(name, 0, HEADER)
            head += store.read(name, HEADER, ENTRY * int.from_bytes(head[12:16], "little"))
            found.append((name, self._wanted(directory(head, sizes[name]))))
        most = TOGETHER if sum(len(groups) for _, groups in found) > ALONE else 0
        for name, groups in found:
            mine, size = None, 0
            for g in groups:
                size += g[2]
                if mine is None or size > most:
                    mine, size = GroupPartition(name), g[2]
                    out.append(mine)
                mine.groups.append(g)
        return out

    def _wanted(self, entries):
        """(start, offset, length) of the groups that hold any epoch asked for."""
        return [(s, at, n) for s, c, at, n in entries if s < self.high and s + c > self.low and self.starts[0] <= s < self.starts[1]]

    def read(self, partition):
        name = partition.name
        if not partition.groups:
            whole = inflate(name, store.read(name))
            for start, at, size in self._wanted(directory(whole)):
                yield self._batch(name, start, at, lambda a, n, at=at: whole[at + a : at + a + n], size)
        for start, at, size in partition.groups:
            yield self._batch(name, start, at, lambda a, n, at=at: store.read(name, at + a, n), size)

    def _batch(self, name, start, at, read, size) -> pa.RecordBatch:
        if not self.flags:
            return block_batch(start, read(0, size), self.pos_from, self.arrow)
        first, heads = packets.read_heads(read, size)
        n, width = heads.shape
        places = at + first + packets.FLAG_AT + width * np.arange(n, dtype=np.int64)
        hashes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(32 * np.arange(n + 1, dtype=np.int32)), pa.py_buffer(heads[:, :32].tobytes())])
        flags = pa.array(heads[:, packets.FLAG_AT].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, start, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(places), hashes, flags], self.arrow.names)


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Writes (name, content) rows as files: under other names first, renamed when the job commits."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows):
        return _Message([(store.write_aside(self.path, row["content"]), f"{self.path}/{row['name']}") for row in rows])

    def commit(self, messages):
        for m in messages:
            for temporary, final in m.files if m else ():
                store.rename(temporary, final)

    def abort(self, messages):
        for m in messages:
            for temporary, _ in m.files if m else ():
                store.remove(temporary)


class ContainerSource(DataSource):
    """``spark.read.format("epochpack").option("posFrom", height).load(path)`` on a store that Arrow opens.

    Blocks of all containers of a folder; with the option ``columns`` =
    ``flags``, the place of each block's flag byte instead (``SITES``); with
    ``compressed`` = ``false``, of uncompressed files alone.
    ``write`` takes (name, content).
    """

    @classmethod
    def name(cls):
        return "epochpack"

    def schema(self):
        return SITES if self.options.get("columns") == "flags" else SCHEMA

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


#: A reader of a data source may only take filters where this is set.
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session, and lets it take filters."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(ContainerSource)


def verify_packets(groups: DataFrame) -> DataFrame:
    """(start_epoch, blocks, tx_blocks, tx_items, transactions, problem) of (start_epoch, packet) rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for start, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows.append({"start_epoch": start} | packets.verify(value.as_py()) | {"problem": None})
                except ValueError as e:
                    rows.append({"start_epoch": start, "blocks": None, "tx_blocks": None, "tx_items": None, "transactions": None, "problem": str(e)})
            kinds = [("start_epoch", pa.int64()), ("blocks", pa.int64()), ("tx_blocks", pa.int64()), ("tx_items", pa.int64()), ("transactions", pa.int64()), ("problem", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return groups.select("start_epoch", "packet").mapInArrow(run, "start_epoch bigint, blocks bigint, tx_blocks bigint, tx_items bigint, transactions bigint, problem string")


def transactions(blocks: DataFrame) -> DataFrame:
    """One row per transaction of block rows: the wide transaction table, with its reference if it repeats an earlier one."""
    zipped = F.arrays_zip(F.col("transactions").alias("tx"), F.col("transaction_refs").alias("ref"))
    out = blocks.select("start_epoch", "epoch", F.col("index").alias("block_index"), F.posexplode(zipped).alias("tx_index", "x"))
    return out.select("start_epoch", "epoch", "block_index", "tx_index", "x.tx.*", F.col("x.ref").alias("ref"))
