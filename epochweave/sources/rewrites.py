"""Rewrites of container files where they lie: zero-reward flags in place, and reward events into pivots.

Both find out first what changes, by joins over small columns; only files that
change are read whole and written, under other names that are renamed when the
job commits (``epochpack``). Compressed containers are not touched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.functions.codec import FLAG_ZERO_TOTAL_REWARD
from epochweave.operators.epochs import range_join
from epochweave.session import materialize
from epochweave.sources import containers, packets

REWARDS = "array<struct<address:binary,pos_identifier:binary,reward:binary>>"
_NAME = r"[^/]*$"


def patch_targets(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(start, end, path) of the uncompressed containers of a folder that start within [low, high); none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{containers.SUFFIX}").load(path).select("path")
    stem = rf"_(\d+)_(\d+)\{containers.SUFFIX}$"
    found = files.select(F.regexp_extract("path", stem, 1).alias("start"), F.regexp_extract("path", stem, 2).alias("end"), "path").where("start <> ''")
    found = found.select(F.col("start").cast("long"), F.col("end").cast("long"), "path")
    found = found.where(F.col("start") >= low) if low is not None else found
    found = found.where(F.col("start") < high) if high is not None else found
    if found.isEmpty():
        raise FileNotFoundError("no container files to patch")
    return found


def _content(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(path, content) of some files of a folder."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", f"*{containers.SUFFIX}").load(path)
    return whole.join(files.select("path"), "path", "left_semi").select("path", "content")


def flag_sites(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(path, name, at, hash, flags) of each block of ``files``, read from the records' fixed parts alone."""
    sites = spark.read.format("epochpack").option("columns", "flags").option("compressed", "false").load(path)
    name = F.regexp_extract("path", _NAME, 0)
    return sites.withColumn("name", name).drop("path").join(files.select(name.alias("name"), "path"), "name").select("path", "name", "at", "hash", "flags")


def patch_zero_rewards(spark: SparkSession, path: str, rewards: DataFrame, low: int | None = None, high: int | None = None, dry_run: bool = False) -> dict:
    """Sets the flag byte's bit 6 of every block whose total reward is zero or missing, in the files themselves.

    ``rewards`` is (hash, total_reward). Returns what the files hold
    and what changes: files_scanned, files_changed, blocks_total,
    blocks_flagged, bytes_rewritten, changed_files (a table of names). A second
    run changes nothing; a dry run writes nothing.
    """
    files = materialize(patch_targets(spark, path, low, high), "targets")
    known = rewards.groupBy("hash").agg(F.max(F.col("total_reward") != 0).alias("paid"))
    sites = flag_sites(spark, path, files).join(known, "hash", "left").withColumn("zero", ~F.coalesce("paid", F.lit(False)))
    flips = F.when(F.col("zero") & (F.col("flags").bitwiseAND(FLAG_ZERO_TOTAL_REWARD) == 0), F.col("at"))
    found = materialize(sites.groupBy("path", "name").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("zero").alias("flagged"), F.array_sort(F.collect_list(flips)).alias("flips")), "sites")
    changed = found.where(F.size("flips") > 0)
    total = found.agg(F.sum("blocks").alias("blocks"), F.sum("flagged").alias("flagged"), F.count_if(F.size("flips") > 0).alias("changed")).first()
    report = {"files_scanned": files.count(), "files_changed": total["changed"], "blocks_total": total["blocks"] or 0, "blocks_flagged": total["flagged"] or 0, "bytes_rewritten": 0, "changed_files": changed.select("name")}
    if dry_run or not total["changed"]:
        return report

    def run(batches):
        for batch in batches:
            names, contents = [], []
            for name, content, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = bytearray(content.as_py())
                for at in places:
                    data[at] |= FLAG_ZERO_TOTAL_REWARD
                names.append(name)
                contents.append(bytes(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    patched = _content(spark, path, changed).join(changed, "path").select("name", "content", "flips")
    patched.mapInArrow(run, "name string, content binary").write.format("epochpack").mode("append").save(path)
    lengths = spark.read.format("binaryFile").option("pathGlobFilter", f"*{containers.SUFFIX}").load(path).select("path", "length")
    report["bytes_rewritten"] = lengths.join(changed, "path", "left_semi").agg(F.sum("length")).first()[0]
    return report


def injected(packet: bytes, events: list[dict], pos_from: int) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A packet whose pivots have the reward events of their epochs appended, each under the pivot's own hash, and {epoch: (events before, after)}.

    The new packet is read again and must be the old one but for these events.
    """
    more: dict[int, list] = {}
    for e in events:
        more.setdefault(e["epoch"], []).append(e["account_rewards"])
    return packets.append_rewards(packet, more, pos_from)


def inject_rewards(spark: SparkSession, path: str, events: DataFrame, pos_from: int, low: int | None = None, high: int | None = None, suffix: str = ".patched", dry_run: bool = False) -> DataFrame:
    """Appends reward events to the pivots of their epochs, in containers written anew, and reports (epoch, name, before, after).

    ``events`` is (epoch, account_rewards), several per epoch allowed, applied
    in the order of their contents. Packets without events keep their bytes;
    a file that has any is written with a new directory, under its name and
    ``suffix`` (none: in its place). Epochs that have no pivot in the folder are
    reported with nulls. Not idempotent: each run appends.
    """
    files = patch_targets(spark, path, low, high)
    events = events.select("epoch", F.col("account_rewards").cast(REWARDS).alias("account_rewards"))
    spans = materialize(containers.group_spans(_content(spark, path, files)), "spans")
    hit = range_join(spans.withColumn("until", F.col("start_epoch") + F.col("epochs")), events, "start_epoch", "until", "epoch", containers.EPOCHS)
    hit = materialize(hit.groupBy("path", "start_epoch").agg(F.sort_array(F.collect_list(F.struct("epoch", "account_rewards"))).alias("events")), "events")
    touched = hit.select("path").distinct()
    groups = containers.file_groups(_content(spark, path, touched)).join(hit, ["path", "start_epoch"], "left")
    schema = "path string, start_epoch bigint, epochs bigint, packet binary, counts array<struct<epoch:bigint,before:int,after:int>>"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                packet, counts = injected(r["packet"], r["events"], pos_from) if r["events"] else (r["packet"], {})
                found = [{"epoch": e, "before": a, "after": b} for e, (a, b) in counts.items()]
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "start_epoch": r["start_epoch"], "epochs": r["epochs"], "packet": packet, "counts": found}], _INJECTED)

    done = materialize(groups.select("path", "start_epoch", "epochs", "packet", "events").repartition("path", "start_epoch").mapInArrow(run, schema), "injected")
    name = F.regexp_extract("path", _NAME, 0)
    counted = done.select(name.alias("name"), F.explode("counts").alias("c")).select("name", "c.epoch", "c.before", "c.after")
    if not dry_run:
        changed = done.groupBy("path").agg(F.max(F.size("counts") > 0).alias("any")).where("any").select("path")

        def build(table: pa.Table) -> pa.Table:
            rows = table.select(["start_epoch", "epochs", "packet"]).sort_by("start_epoch")
            content = containers.pack([(s.as_py(), n.as_py(), p.as_py()) for s, n, p in zip(*rows.columns, strict=True)])
            return pa.table({"name": pa.array([table.column("name")[0].as_py()]), "content": pa.array([content], pa.binary())})

        whole = done.join(changed, "path", "left_semi").select("path", F.concat(name, F.lit(suffix)).alias("name"), "start_epoch", "epochs", "packet")
        whole.groupBy("path").applyInArrow(build, "name string, content binary").write.format("epochpack").mode("append").save(path)
    return events.select("epoch").distinct().join(counted, "epoch", "left").select("epoch", "name", "before", "after")


_COUNT = pa.struct([("epoch", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])
_INJECTED = pa.schema([("path", pa.string()), ("start_epoch", pa.int64()), ("epochs", pa.int64()), ("packet", pa.binary()), ("counts", pa.list_(_COUNT))])
