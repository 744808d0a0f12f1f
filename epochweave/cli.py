"""Command line: ``python -m epochweave.cli COMMAND ...`` or through spark-submit."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from epochweave.operators import checks
from epochweave.operators.epochs import contiguity_violations, missing_epochs
from epochweave.plans.extract import Chain, extract_blocks, grouped_epochs, packet_heads
from epochweave.session import materialize
from epochweave.sources import containers, ingest, records, rewrites

TABLES = ("epochs", "headers", "bodies", "rewards", "committed", "pos_rewards", "unlocks", "contexts")


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("epochweave").getOrCreate()
    containers.register(spark)
    return spark


def _packets(spark: SparkSession, path: str):
    """(start_epoch, packet) rows of a folder of containers or of single-packet shards; neither is an error."""
    shards = records.read_shards(spark, path).select("start_epoch", "packet")
    return containers.read_groups(spark, path).select("start_epoch", "packet") if shards.isEmpty() else shards


def extract(args) -> None:
    """Landed tables to containers: blocks, packets per group, containers per job."""
    spark, chain = _session(), Chain.from_toml(args.config) if args.config else Chain()
    tables = {t: spark.read.parquet(f"{args.tables}/{t}") for t in TABLES}
    high = min(args.end, (tables["epochs"].agg(F.max("epoch")).first()[0] or 0) + 1)
    lost = missing_epochs(tables["epochs"], args.start, high).first()
    if lost:
        raise SystemExit(f"epoch {lost['epoch']} is missing")
    blocks = extract_blocks(tables, chain, args.start, high, args.group)
    heads = packet_heads(grouped_epochs(tables, args.start, high, args.group), tables)
    heads = materialize(heads, "heads")
    packed = materialize(containers.encode_packets(blocks, "packet", heads, heads.count()), "packets")
    jobs = packed.withColumn("job", F.floor((F.col("start_epoch") - args.start) / args.group / max(1, args.groups_per_job)))
    if args.shards:
        records.shard_files(packed).write.format("epochpack").mode("append").save(args.output)
    else:
        containers.build_containers(jobs, target=args.target).write.format("epochpack").mode("append").save(args.output)


def verify(args) -> None:
    """Structure of all packets of containers or shards, and groups that do not start where another ends, or behind the height of --resume."""
    spark = _session()
    containers.verify_packets(_packets(spark, args.path)).orderBy("start_epoch").show(args.rows, truncate=False)
    if records.read_shards(spark, args.path).isEmpty():
        contiguity_violations(containers.read_groups(spark, args.path).select("start_epoch", "epochs"), "start_epoch", "epochs", args.resume).show(args.rows)


def inspect(args) -> None:
    """Block rows of containers or shards, first ones first; with --output all of them as Parquet."""
    blocks = containers.decode_packets(_packets(_session(), args.path), args.pos_from)
    if args.output:
        blocks.write.parquet(args.output)
    blocks.where((F.col("epoch") >= args.start) & (F.col("epoch") < args.end)).orderBy("start_epoch", "index").select("start_epoch", "index", "epoch", "height", "flags", F.hex("hash").alias("hash"), F.size("transactions").alias("txs")).show(args.rows, truncate=False)


def roundtrip(args) -> None:
    """Packets whose decoded blocks do not encode to the same bytes: none means all are equal."""
    records.roundtrip(_packets(_session(), args.path), args.pos_from).where("not equal").show(args.rows)


def replay(args) -> None:
    """Counts that a replay of the packets would meet, and blocks that break a rule."""
    blocks = containers.decode_packets(_packets(_session(), args.path), args.pos_from)
    counts = checks.replay_counts(blocks)
    counts.agg(F.count(F.lit(1)).alias("packets"), *(F.sum(c).alias(c) for c in counts.columns[1:])).show(truncate=False)
    checks.replay_problems(blocks).show(args.rows, truncate=False)


def bench_decode(args) -> None:
    """Seconds to load all packets, then to decode them, and epochs and blocks a second of decoding."""
    spark = _session()
    began = time.perf_counter()
    groups = materialize(_packets(spark, args.path), "bench")
    size = groups.agg(F.sum(F.length("packet")).alias("bytes"), F.count(F.lit(1)).alias("packets")).first()
    loaded = time.perf_counter()
    row = containers.decode_packets(groups, args.pos_from).agg(F.countDistinct("epoch").alias("epochs"), F.count(F.lit(1)).alias("blocks")).first()
    load, decode = loaded - began, time.perf_counter() - loaded
    print({"packets": size["packets"], "bytes": size["bytes"], "epochs": row["epochs"], "blocks": row["blocks"], "load_seconds": round(load, 3), "decode_seconds": round(decode, 3), "epochs_per_second": round(row["epochs"] / decode, 1), "blocks_per_second": round(row["blocks"] / decode, 1)})


def flag(args) -> None:
    """Zero-reward flags from a rewards table: what would change, or the patched blocks as Parquet."""
    spark = _session()
    blocks = containers.decode_packets(_packets(spark, args.path), args.pos_from)
    patched = checks.patch_zero_reward(blocks, spark.read.parquet(args.rewards), "hash", height="height", low=args.start, high=args.end)
    if args.output and not args.dry_run:
        patched.drop("changed").write.parquet(args.output)
    checks.patch_summary(patched).show()


def patch(args) -> None:
    """Zero-reward flags from a rewards table (hash, total_reward), set in the container files that start within the range."""
    spark = _session()
    report = rewrites.patch_zero_rewards(spark, args.path, spark.read.parquet(args.rewards), args.start, args.end, args.dry_run)
    names = sorted(r["name"] for r in report.pop("changed_files").collect())
    print(report)
    print(*names, sep="\n")


def inject(args) -> None:
    """Reward events (epoch, account_rewards) appended to pivots, in container files with a suffix or in place."""
    spark = _session()
    rewrites.inject_rewards(spark, args.path, spark.read.parquet(args.events), args.pos_from, args.start, args.end, args.suffix, args.dry_run).orderBy("epoch").show(args.rows, truncate=False)


def dump(args) -> None:
    """Raw reward records (key, value) as rows, those of one PoS epoch or all; with --output as JSON files."""
    spark = _session()
    found = ingest.reward_records(spark.read.parquet(args.records))
    found = found.where(F.col("pos_epoch") == args.epoch) if args.epoch is not None else found
    if args.epoch is not None and found.isEmpty():
        raise SystemExit(f"no entry for PoS epoch {args.epoch}")
    account = lambda a: F.struct(F.concat(F.lit("0x"), F.lower(F.hex(a["address"]))).alias("address"), F.concat(F.lit("0x"), F.lower(F.hex(a["pos_identifier"]))).alias("pos_identifier"), F.concat(F.lit("0x"), F.lower(F.hex(a["reward"]))).alias("reward"))
    shown = found.select("pos_epoch", F.concat(F.lit("0x"), F.lower(F.hex("execution_hash"))).alias("execution_epoch_hash"), F.transform("account_rewards", account).alias("account_rewards"))
    if args.output:
        shown.write.json(args.output)
    shown.select("pos_epoch", "execution_epoch_hash", F.size("account_rewards").alias("accounts")).orderBy("pos_epoch").show(args.rows, truncate=False)


def extract_blocks_raw(args) -> None:
    """Landed tables to block rows as Parquet, without packets; ``encode-blocks`` makes containers of them."""
    spark, chain = _session(), Chain.from_toml(args.config) if args.config else Chain()
    tables = {t: spark.read.parquet(f"{args.tables}/{t}") for t in TABLES}
    blocks = extract_blocks(tables, chain, args.start, args.end, args.group)
    blocks.write.parquet(f"{args.output}/blocks")
    packet_heads(spark.read.parquet(f"{args.output}/blocks"), tables).write.parquet(f"{args.output}/heads")


def encode_blocks(args) -> None:
    """Block rows of ``extract-blocks-raw`` to containers."""
    spark = _session()
    packed = materialize(containers.encode_packets(spark.read.parquet(f"{args.path}/blocks"), "packet", spark.read.parquet(f"{args.path}/heads")), "packets")
    containers.build_containers(packed.withColumn("job", F.lit(0)), target=args.target).write.format("epochpack").mode("append").save(args.output)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="epochweave")
    sub = p.add_subparsers(required=True)

    def command(f, *names: str):
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        for n in names:
            c.add_argument(n)
        c.add_argument("--rows", type=int, default=50)
        c.add_argument("--pos-from", type=int, default=(1 << 63) - 1)
        c.add_argument("--start", type=int, default=0)
        c.add_argument("--end", type=int, default=1 << 62)
        c.add_argument("--output")
        return c

    c = command(extract, "tables")
    c.add_argument("--config")
    c.add_argument("--group", type=int, default=containers.EPOCHS)
    c.add_argument("--groups-per-job", type=int, default=64)
    c.add_argument("--shards", action="store_true")
    c.add_argument("--target", type=int, default=containers.TARGET)
    command(verify, "path").add_argument("--resume", type=int, default=0)
    command(replay, "path")
    command(bench_decode, "path")
    command(inspect, "path")
    command(roundtrip, "path")
    command(flag, "path", "rewards").add_argument("--dry-run", action="store_true")
    command(patch, "path", "rewards").add_argument("--dry-run", action="store_true")
    c = command(inject, "path", "events")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--suffix", default=".patched")
    command(dump, "records").add_argument("--epoch", type=int)
    c = command(extract_blocks_raw, "tables")
    c.add_argument("--config")
    c.add_argument("--group", type=int, default=containers.EPOCHS)
    command(encode_blocks, "path").add_argument("--target", type=int, default=containers.TARGET)
    args = p.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
