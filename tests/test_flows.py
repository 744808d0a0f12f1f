import os
import time

import pytest
from pyspark.sql import functions as F

from epochweave import cli
from epochweave.functions.codec import rlp
from epochweave.functions.keccak import EMPTY
from epochweave.operators import epochs
from epochweave.plans.extract import Chain, extract_blocks, grouped_epochs, packet_heads
from epochweave.sources import containers, packets
from epochweave.state.manager import MemoryStore, StateManager
from epochweave.streaming import periods

H = lambda n: n.to_bytes(32, "big")


N = 12


def landed(spark):
    """Landed tables of 12 epochs of 3 blocks."""
    n = N
    epochs = spark.createDataFrame([(e, H(3 * e + 2), [H(3 * e), H(3 * e + 2)], [H(3 * e + 1)]) for e in range(n)], "epoch bigint, pivot_hash binary, executed array<binary>, skipped array<binary>")
    headers = spark.createDataFrame([(H(i), i // 3, i % 2 == 0, bytes([i % 4]) * 20, 1000 + i, H(5), 30_000_000, 0, 0, 0, bytes(32), bytes(32), bytes(32), H(900 + i // 3) if i >= 15 else None) for i in range(3 * n)], "hash binary, height bigint, adaptive boolean, author binary, timestamp bigint, difficulty binary, gas_limit bigint, base_price_core bigint, base_price_espace bigint, blame bigint, deferred_state_root binary, deferred_receipts_root binary, deferred_logs_bloom_hash binary, pos_ref binary")
    bodies = spark.createDataFrame([], f"hash binary, transactions array<{packets.TX}>")
    rewards = spark.createDataFrame([(H(i), i % 2, 7) for i in range(20)], "hash binary, total_reward bigint, base_reward bigint")
    committed = spark.createDataFrame([(H(900 + k), H(3 * max(k - 3, 0) + 2), 50 + k, 10 * k) for k in range(n)], "pos_ref binary, pivot_decision binary, view bigint, version bigint")
    pos = spark.createDataFrame([(H(3 * 7 + 2), 1, [(bytes(20), H(1), H(2))]), (H(3 * 7 + 2), 2, [(bytes(20), H(1), H(3))]), (H(999), 1, [(bytes(20), H(1), H(4))])], "execution_hash binary, pos_epoch bigint, account_rewards array<struct<address:binary,pos_identifier:binary,reward:binary>>")
    unlocks = spark.createDataFrame([(v, H(v), v) for v in (49, 50, 61, 70, 200)], "version bigint, identifier binary, unlocked bigint")
    contexts = spark.createDataFrame([(H(3 * e + 2), 500 + 3 * e) for e in range(n)], "hash binary, start_block_number bigint")
    return {"epochs": epochs, "headers": headers, "bodies": bodies, "rewards": rewards, "committed": committed, "pos_rewards": pos, "unlocks": unlocks, "contexts": contexts}


def test_extraction_to_packets(spark, tmp_path):
    """The tables become packets of 6 epochs that read back the same."""
    n, tables = N, landed(spark)
    blocks = extract_blocks(tables, Chain(pos_reference_enable_height=6), 0, n, 6).cache()
    got = {(r["packet"], r["index"]): r for r in blocks.collect()}
    assert len(got) == 36 and [got[0, i]["hash"] for i in range(3)] == [H(0), H(1), H(2)]
    pivot = got[1, 5]
    assert pivot["hash"] == H(23) and pivot["pos_view"] == 57 and pivot["finalized_epoch"] == 3
    assert [x["account_rewards"][0]["reward"] for x in pivot["pos_rewards"]] == [H(3)]
    assert [u["unlocked"] for u in pivot["unlock_events"]] == [61]
    assert got[0, 1]["flags"] & 32 and got[0, 2]["flags"] & 6 == 6 and got[1, 17]["flags"] & 64
    heads = packet_heads(blocks, tables)
    assert {(r["packet"], bytes(r["prev_last_hash"]), r["first_block_number"]) for r in heads.collect()} == {(0, H(2), 500), (1, H(17), 518)}
    with pytest.raises(Exception, match="context is missing"):
        packet_heads(blocks, tables | {"contexts": tables["contexts"].limit(0)}).collect()
    packed = containers.encode_packets(blocks, "packet", heads)
    entries = [packets.decode(bytes(r["packet"]), 6)[0]["pos_entries"] for r in packed.orderBy("start_epoch").collect()]
    assert entries == [[], [(H(906 + i), i) for i in range(6)]]
    back = containers.decode_packets(packed, 6).collect()
    assert len(back) == 36 and {(r["hash"], r["epoch"], r["flags"], r["pos_view"]) for r in back} == {(r["hash"], r["epoch"], r["flags"] | (8 if r["pos_rewards"] or r["unlock_events"] else 0), r["pos_view"]) for r in got.values()}


def test_extraction_deals_blocks_once(spark):
    """Headers meet the resolved references, and then all tables meet under the hash: no wide row is dealt again by packet, epoch or another hash."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = extract_blocks(landed(spark), Chain(pos_reference_enable_height=6), 0, N, 6)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide, todo = [], [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange" and "author#" in node.output().mkString(" "):
            wide.append(node.outputPartitioning().toString().split("#")[0])
    assert sorted(wide) == ["hashpartitioning(hash", "hashpartitioning(pos_ref"]


def test_places_are_those_of_ordered_blocks(spark):
    """One pass over the epochs numbers blocks as sorting them does, with pivots among the executed ones or not, and sets that are empty or not there."""
    rows = [(e, H(9 * e), [H(9 * e + i) for i in range(e % 3, e % 4)], [None, [], [H(9 * e + 7), H(9 * e + 8)]][e % 3], e // 5) for e in range(20)]
    sets = spark.createDataFrame(rows, "epoch bigint, pivot_hash binary, executed array<binary>, skipped array<binary>, packet bigint")
    order = epochs.ordered_blocks(sets).withColumn("packet", F.floor(F.col("epoch") / 5)).withColumn("order", F.struct("epoch", "class", "pos"))
    want = epochs.number_blocks(order, F.lit(0), "order").select("packet", "epoch", "class", "block_number", "hash").collect()
    got = epochs.placed_blocks(sets).collect()
    assert len(got) > 30 and sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_packets_are_dealt_by_their_number(spark, monkeypatch):
    """However few bytes packets have, tasks get no more than some of them, and the rows are the same."""
    monkeypatch.setattr(containers, "PER_TASK", 2)
    tables = landed(spark)
    blocks, heads = extract_blocks(tables, Chain(pos_reference_enable_height=6), 0, N, 1).cache(), packet_heads(grouped_epochs(tables, 0, N, 1), tables)
    assert sorted(map(str, heads.collect())) == sorted(map(str, packet_heads(blocks, tables).collect()))
    packed = containers.encode_packets(blocks, "packet", heads, N)
    back = containers.decode_packets(packed, 6, N)
    assert packed.rdd.getNumPartitions() == back.rdd.getNumPartitions() == N // 2
    assert sorted(map(str, back.collect())) == sorted(map(str, containers.decode_packets(containers.encode_packets(blocks, "packet", heads), 6).collect()))


def test_commands(spark, tmp_path, capsys):
    """Tables to containers and shards by the command line, then verify, inspect, round trip and replay of both."""
    config = tmp_path / "chain.toml"
    config.write_text("pos_reference_enable_height = 6\n")
    for name, df in landed(spark).items():
        df.write.parquet(f"{tmp_path}/tables/{name}")
    for out, more in (("containers", []), ("shards", ["--shards"])):
        folder = f"{tmp_path}/{out}"
        cli.main(["extract", f"{tmp_path}/tables", "--config", str(config), "--group", "6", "--output", folder, *more])
        capsys.readouterr()
        cli.main(["verify", folder])
        seen = capsys.readouterr().out
        assert "|0          |18" in seen and "|6          |18" in seen
        cli.main(["replay", folder, "--pos-from", "6"])
        seen = capsys.readouterr().out.splitlines()
        assert seen[3].replace(" ", "") == "|2|12|36|0|0|0|0|" and seen[9].startswith("+")
        cli.main(["roundtrip", folder, "--pos-from", "6"])
        assert len(capsys.readouterr().out.splitlines()) == 5
        cli.main(["inspect", folder, "--pos-from", "6", "--start", "7", "--end", "8"])
        assert capsys.readouterr().out.count("\n|6 ") == 3
    with pytest.raises(SystemExit, match="epoch 12 is missing"):
        spark.createDataFrame([(20, H(1), [H(1)], [])], "epoch bigint, pivot_hash binary, executed array<binary>, skipped array<binary>").write.mode("append").parquet(f"{tmp_path}/tables/epochs")
        cli.main(["extract", f"{tmp_path}/tables", "--output", f"{tmp_path}/none"])
    with pytest.raises(FileNotFoundError):
        cli.main(["verify", f"{tmp_path}/tables"])


def test_stream_of_layers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, schema = f"{tmp_path}/in", "key string, height bigint, value bigint"
    os.makedirs(source)
    query = periods.rotate_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 10).writeStream.outputMode("update").format("memory").queryName("layers").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for i, rows in enumerate([[("a", 1, 1), ("b", 2, 5)], [("a", 11, 2)], [("a", 25, None)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/x{i}")
            part = next(f for f in os.listdir(f"{tmp_path}/x{i}") if f.endswith(".parquet"))
            os.rename(f"{tmp_path}/x{i}/{part}", f"{source}/{i}.parquet")
            time.sleep(0.1)
            query.processAllAvailable()
        got = [(r["key"], r["period"], r["snapshot"], r["intermediate"], r["delta"]) for r in spark.table("layers").collect()]
    finally:
        query.stop()
    assert sorted(got, key=repr) == sorted([("a", 0, None, None, 1), ("b", 0, None, None, 5), ("a", 1, None, 1, 2), ("a", 2, 1, 2, None)], key=repr)


def test_micro_batches_commit_once(spark):
    manager, roots = StateManager(spark, MemoryStore(), 100), []
    sink = periods.commit_batches(manager, lambda i, root: roots.append((i, root.delta_root)))
    batch = spark.createDataFrame([(0, "account", b"\1" * 20, None, "native", b"v")], "seq bigint, kind string, address binary, suffix binary, space string, value binary")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.limit(0), 1)
    assert [i for i, _ in roots] == [0, 1] and manager.height == 2 and roots[0][1] == roots[1][1] != EMPTY


def test_commands_that_rewrite(spark, tmp_path, capsys):
    """Blocks first and packets later are the same containers; flags and rewards go into them; raw rewards are shown."""
    config = tmp_path / "chain.toml"
    config.write_text("pos_reference_enable_height = 6\n")
    for name, df in landed(spark).items():
        df.write.parquet(f"{tmp_path}/tables/{name}")
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    cli.main(["extract", f"{tmp_path}/tables", "--config", str(config), "--group", "6", "--output", one])
    cli.main(["extract-blocks-raw", f"{tmp_path}/tables", "--config", str(config), "--group", "6", "--end", "12", "--output", f"{tmp_path}/raw"])
    cli.main(["encode-blocks", f"{tmp_path}/raw", "--output", two])
    files = lambda folder: {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder)}
    assert files(one) == files(two) != {}
    rewards = spark.createDataFrame([(H(i), i % 5) for i in range(30)], "hash binary, total_reward bigint")
    rewards.write.parquet(f"{tmp_path}/rewards")
    capsys.readouterr()
    cli.main(["patch", one, f"{tmp_path}/rewards"])
    assert "'blocks_flagged': 12" in capsys.readouterr().out and files(one) != files(two)
    cli.main(["patch", one, f"{tmp_path}/rewards"])
    assert "'files_changed': 0" in capsys.readouterr().out
    spark.createDataFrame([(3, [(bytes(20), H(1), H(9))])], "epoch bigint, account_rewards array<struct<address:binary,pos_identifier:binary,reward:binary>>").write.parquet(f"{tmp_path}/events")
    cli.main(["inject", one, f"{tmp_path}/events", "--pos-from", "6"])
    assert "|3    |" in capsys.readouterr().out and sum(n.endswith(".patched") for n in os.listdir(one)) == 1
    cli.main(["bench-decode", one, "--pos-from", "6"])
    assert "'load_seconds'" in capsys.readouterr().out
    raw = [((7).to_bytes(8, "big"), rlp([[[bytes(20), H(1), 300]], H(5)])), (b"short", rlp([[], H(6)])), ((8).to_bytes(8, "big"), b"\xff")]
    spark.createDataFrame(raw, "key binary, value binary").write.parquet(f"{tmp_path}/records")
    cli.main(["dump", f"{tmp_path}/records", "--output", f"{tmp_path}/json"])
    (row,) = spark.read.json(f"{tmp_path}/json").collect()
    assert row["pos_epoch"] == 7 and row["account_rewards"][0]["reward"] == "0x" + (300).to_bytes(32, "big").hex()
    with pytest.raises(SystemExit, match="no entry"):
        cli.main(["dump", f"{tmp_path}/records", "--epoch", "9"])


def test_resume_and_gaps(spark, tmp_path):
    """Groups must go on where the last one ended, in a table and in a stream, behind a checkpoint if there is one."""
    from epochweave.operators.epochs import contiguity_violations

    groups = spark.createDataFrame([(1, 10), (11, 10), (31, 5)], "start bigint, n bigint")
    seen = lambda resume: sorted(r["start"] for r in contiguity_violations(groups, "start", "n", resume).collect())
    assert seen(0) == [31] and seen(5) == [1, 31] and seen(30) == [1, 31]
    assert sorted(r["start"] for r in contiguity_violations(groups.where("start > 1"), "start", "n", 10).collect()) == [31]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, schema = f"{tmp_path}/in", "job string, start_epoch bigint, epochs bigint"
    os.makedirs(source)
    query = periods.contiguity_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 10).writeStream.outputMode("append").format("memory").queryName("gaps").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for i, rows in enumerate([[("a", 11, 5), ("b", 12, 3)], [("a", 21, 5), ("a", 16, 5)], [("a", 30, 1), ("b", 15, 1)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/x{i}")
            part = next(f for f in os.listdir(f"{tmp_path}/x{i}") if f.endswith(".parquet"))
            os.rename(f"{tmp_path}/x{i}/{part}", f"{source}/{i}.parquet")
            query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("gaps").collect())
    finally:
        query.stop()
    assert got == [("a", 30, 26), ("b", 12, 11)]


def test_scopes_of_threads_do_not_meet(spark):
    """Tables that another thread makes are not in this one's scope, and a scope inside has its own."""
    from concurrent.futures import ThreadPoolExecutor

    from epochweave.session import materialize, release, scope

    mine, inner = [], []
    with scope(mine), ThreadPoolExecutor(1) as pool:
        one = materialize(spark.range(3))
        pool.submit(lambda: materialize(spark.range(4))).result()
        with scope(inner):
            two = materialize(spark.range(5))
    materialize(spark.range(6))
    assert mine == [one.scratch, two.scratch] and inner == [two.scratch]
    release(spark, mine, two.where("id > 1"))
    assert mine == [two.scratch] and two.count() == 5
