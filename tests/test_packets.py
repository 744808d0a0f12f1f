import random

import pytest

from epochweave.functions.codec import rlp
from epochweave.sources import containers, packets, rewrites

A = [bytes([i]) * 20 for i in range(1, 6)]


def transaction(r: random.Random, epoch: int) -> dict:
    native = r.random() < 0.6
    kind = r.choice(packets.NATIVE_TYPES if native else packets.ETHEREUM_TYPES)
    call = kind == 4 or r.random() < 0.7
    return {
        "space": "native" if native else "ethereum", "type_id": kind, "sender": r.choice(A), "nonce": r.randrange(1 << 40), "gas_price": packets.wide(r.choice([5, 7, 1 << 70])), "priority_price": packets.wide(r.choice([5, 9])) if kind in (2, 4) else None,
        "gas": r.randrange(1 << 30), "action": "call" if call else "create", "to": r.choice(A) if call else None, "value": packets.wide(r.randrange(1 << 90)), "storage_limit": r.randrange(99) if native else None,
        "epoch_height": epoch - 100 + r.randrange(200) if native else None, "data": bytes(r.randrange(256) for _ in range(r.randrange(300))), "access_list_rlp": rlp([[A[0], [b"k" * 32]]]) if kind else None, "authorization_list_rlp": rlp([[b"\1", A[1]]]) if kind == 4 and not native else None,
    }


def packet(seed: int, n: int, pos_from: int) -> list[dict]:
    r = random.Random(seed)
    pivots = sorted(r.sample(range(n - 1), min(n - 1, n // 3))) + [n - 1]
    out, seen = [], []
    for i in range(n):
        height = 1000 + i
        pivot = next(p for p in pivots if p >= i)
        txs = [r.choice(seen) if seen and r.random() < 0.3 else transaction(r, 1000 + pivot) for _ in range(r.randrange(4))]
        txs = [t if t["space"] == "ethereum" or abs(t["epoch_height"] - 1000 - pivot) < 10**6 else t for t in txs]
        seen += txs
        out.append(
            {"epoch": 1000 + pivot, "index": i, "hash": r.randbytes(32), "deferred_state_root": r.randbytes(4).ljust(32, b"\0"), "deferred_receipts_root": r.randbytes(4).ljust(32, b"\0"), "deferred_logs_bloom_hash": r.randbytes(4).ljust(32, b"\0"), "flags": (2 if i == pivot else 0) | r.choice([0, 1, 32, 64])}
            | {"author": r.choice(A), "timestamp": 10**9 + r.randrange(5000), "difficulty": packets.wide(r.choice([3, 10**15])), "gas_limit": r.choice([0, 30_000_000, 60_000_000, 12345]), "base_price_core": r.choice([0, 10**9, 17]), "base_price_espace": r.choice([0, 2 * 10**10, 10**9])}
            | {"height": height, "blame": r.randrange(16), "finalized_epoch": r.randrange(3), "base_reward": r.randrange(1 << 80), "pos_view": 50 + i if height >= pos_from else None, "transactions": txs, "transaction_refs": []}
            | {"pos_rewards": [{"account_rewards": [{"address": A[2], "pos_identifier": b"p" * 32, "reward": packets.wide(77)}], "execution_epoch_hash": b"e" * 32}] if r.random() < 0.2 else [], "unlock_events": [{"identifier": b"u" * 32, "unlocked": 100}] if r.random() < 0.2 else []}
        )
    return out


@pytest.mark.parametrize("seed", range(8))
def test_round_trip(seed):
    blocks = packet(seed, 1 + seed * 7, 1010)
    data = packets.encode(blocks, b"h" * 32, b"s" * 32, 42)
    head, got = packets.decode(data, 1010)
    assert head["first_block_number"] == 42 and packets.verify(data)["blocks"] == len(blocks)
    for b, g in zip(blocks, got, strict=True):
        assert {k: v for k, v in b.items() if k not in ("transaction_refs", "flags")} == {k: v for k, v in g.items() if k not in ("transaction_refs", "flags")}
        assert b["flags"] == g["flags"] & ~24
    again = packets.encode([g | {"flags": b["flags"]} for g, b in zip(got, blocks, strict=True)], b"h" * 32, b"s" * 32, 42)
    assert again == data
    assert [data[at] & 66 for at, _ in packets.flag_sites(data)] == [b["flags"] & 66 for b in blocks]


def test_refuses_broken_input():
    blocks = packet(1, 6, 10**9)
    for change in ({"index": 5}, {"flags": 130}, {"epoch": 1}):
        with pytest.raises(ValueError):
            packets.check_blocks([blocks[0] | change, *blocks[1:]])
    with pytest.raises(ValueError):
        packets.check_blocks([])
    data = packets.encode(blocks, b"h" * 32, b"s" * 32, 0)
    for cut in (50, 124, len(data) // 2):
        with pytest.raises((ValueError, IndexError)):
            packets.verify(data[:cut])
    with pytest.raises(ValueError):
        containers.directory(b"no container at all, really")


def test_sources(spark, tmp_path):
    from decimal import Decimal

    import zstandard

    groups = []
    for i in range(5):
        blocks = packet(i, 9, 1000)
        for b in blocks:
            b.update(height=b["height"] + 100 * i, epoch=b["epoch"] + 100 * i)
        groups.append((min(b["epoch"] for b in blocks), 9, packets.encode(blocks, b"h" * 32, b"s" * 32, i), blocks))
    table = spark.createDataFrame([(0, s, c, p) for s, c, p, _ in groups], "job int, start_epoch bigint, epochs bigint, packet binary")
    files = containers.build_containers(table, target=len(groups[0][2]) + 10)
    containers.register(spark)
    files.write.format("epochpack").mode("append").save(str(tmp_path))
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) == files.count() and all(n.startswith("epochs_") for n in names)
    first = tmp_path / names[0]
    (tmp_path / (names[0] + ".zst")).write_bytes(zstandard.ZstdCompressor().compress(first.read_bytes()))
    direct = spark.read.format("epochpack").option("posFrom", 1000).load(str(tmp_path))
    through = containers.read_containers(spark, str(tmp_path), 1000)
    assert direct.count() == through.count() == 45
    wanted = sorted((b["epoch"], b["index"], b["hash"], Decimal(b["base_reward"]), b["pos_view"], len(b["transactions"])) for *_, bs in groups for b in bs)
    for df in (direct, through):
        assert sorted((r["epoch"], r["index"], bytes(r["hash"]), r["base_reward"], r["pos_view"], len(r["transactions"])) for r in df.collect()) == wanted
    heads = through.select("start_epoch").distinct().selectExpr("start_epoch", "cast(repeat('h', 32) as binary) prev_last_hash", "cast(repeat('s', 32) as binary) prev_last_deferred_state_root", "0L first_block_number")
    again = containers.encode_packets(through.withColumn("flags", through["flags"].bitwiseAND(~24)), "start_epoch", heads)
    assert sorted(r["n_blocks"] for r in again.collect()) == [9] * 5
    checked = containers.verify_packets(again.unionByName(again.limit(1).selectExpr("start_epoch", "epochs", "n_blocks", "cast('junk' as binary) packet")))
    assert checked.where("problem is not null").count() == 1
    assert containers.transactions(through).count() == sum(len(b["transactions"]) for *_, bs in groups for b in bs)
    pruned = spark.read.format("epochpack").option("posFrom", 1000).option("fromEpoch", 1300).load(str(tmp_path))
    assert 0 < pruned.count() < 45


def container_folder(spark, folder, seeds=range(5), per_file=2):
    """Containers of a few groups of nine epochs each, and the blocks in them."""
    groups = []
    for i in seeds:
        blocks = packet(i, 9, 1000)
        for b in blocks:
            b.update(height=b["height"] + 9 * i, epoch=b["epoch"] + 9 * i)
        groups.append((1000 + 9 * i, 9, packets.encode(blocks, b"h" * 32, b"s" * 32, i), blocks))
    table = spark.createDataFrame([(n // per_file, s, c, p) for n, (s, c, p, _) in enumerate(groups)], "job int, start_epoch bigint, epochs bigint, packet binary")
    containers.register(spark)
    containers.build_containers(table).write.format("epochpack").mode("append").save(str(folder))
    return groups


def test_compressed_containers_of_several_groups(spark, tmp_path):
    import zstandard

    groups = container_folder(spark, tmp_path, per_file=3)
    for p in list(tmp_path.iterdir()):
        (tmp_path / (p.name + ".zst")).write_bytes(zstandard.ZstdCompressor().compress(p.read_bytes()))
        p.unlink()
    got = spark.read.format("epochpack").option("posFrom", 1000).load(str(tmp_path))
    assert sorted((r["start_epoch"], r["index"], bytes(r["hash"])) for r in got.collect()) == [(s, b["index"], b["hash"]) for s, _, _, bs in groups for b in bs]


def test_filters_and_flags_read_little(spark, tmp_path, monkeypatch):
    """Filters on epochs choose groups before anything is decoded; flags come from the records alone."""
    groups = container_folder(spark, tmp_path)
    load = lambda **o: spark.read.format("epochpack").options(posFrom=1000, **o).load(str(tmp_path))
    some = load().where("epoch >= 1010 and epoch < 1020")
    assert some.rdd.getNumPartitions() == 2 and load().rdd.getNumPartitions() == 5
    assert sorted(bytes(r["hash"]) for r in some.collect()) == sorted(b["hash"] for *_, bs in groups for b in bs if 1010 <= b["epoch"] < 1020)
    assert load().where("start_epoch = 1018").rdd.getNumPartitions() == 1
    sites = load(columns="flags").collect()
    assert sorted((bytes(r["hash"]), r["flags"] & 66) for r in sites) == sorted((b["hash"], b["flags"] & 66) for *_, bs in groups for b in bs)
    for r in sites:
        with open(r["path"], "rb") as f:
            f.seek(r["at"])
            assert f.read(1)[0] == r["flags"]
    asked = []
    packets.read_sites(lambda a, n: asked.append(n) or groups[3][2][a : a + n], len(groups[3][2]))
    assert sum(asked) < len(groups[3][2]) / 2


def test_flags_in_place(spark, tmp_path):
    """Only files with a change are written, only flag bytes differ, a second run changes nothing."""
    groups = container_folder(spark, tmp_path)
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    blocks = [b for *_, bs in groups for b in bs]
    last = {b["hash"] for b in groups[4][3]}
    paid = {b["hash"]: i % 3 for i, b in enumerate(blocks) if i % 4 and b["hash"] not in last} | {h: 5 for h in last}
    rewards = spark.createDataFrame(list(paid.items()), "hash binary, total_reward bigint")
    zero = {b["hash"] for b in blocks if not paid.get(b["hash"], 0)}
    dry = rewrites.patch_zero_rewards(spark, str(tmp_path), rewards, dry_run=True)
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before and dry["bytes_rewritten"] == 0
    done = rewrites.patch_zero_rewards(spark, str(tmp_path), rewards)
    after = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    changed = {n for n in before if before[n] != after[n]}
    assert set(after) == set(before) and {r["name"] for r in done["changed_files"].collect()} == changed == {r["name"] for r in dry["changed_files"].collect()}
    assert (done["files_scanned"], done["files_changed"], done["blocks_total"], done["blocks_flagged"]) == (3, 2, 45, len(zero)) and done["bytes_rewritten"] == sum(len(after[n]) for n in changed)
    sites = spark.read.format("epochpack").option("columns", "flags").load(str(tmp_path)).collect()
    was = {b["hash"]: b["flags"] & 64 for b in blocks}
    assert all(bool(r["flags"] & 64) == (bytes(r["hash"]) in zero or bool(was[bytes(r["hash"])])) for r in sites)
    places = {(r["path"].rsplit("/", 1)[-1], r["at"]) for r in sites}
    assert all((n, i) in places for n in before for i, (x, y) in enumerate(zip(before[n], after[n], strict=True)) if x != y)
    assert rewrites.patch_zero_rewards(spark, str(tmp_path), rewards)["files_changed"] == 0
    ranged = rewrites.patch_zero_rewards(spark, str(tmp_path), rewards.limit(0), low=1018, high=1030)
    assert ranged["files_scanned"] == 1 and ranged["blocks_total"] == 18
    with pytest.raises(FileNotFoundError):
        rewrites.patch_targets(spark, str(tmp_path), low=9999)


def test_rewards_into_containers(spark, tmp_path):
    """Events reach the pivots of their epochs; all else decodes as before, and files without events are not written."""
    groups = container_folder(spark, tmp_path)
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    pivots = [b for *_, bs in groups for b in bs if b["flags"] & 2]
    one, two = pivots[0], next(b for b in pivots if b["epoch"] >= groups[2][0])
    account = lambda n: [{"address": A[n], "pos_identifier": bytes([n]) * 32, "reward": packets.wide(10**20 + n)}]
    events = spark.createDataFrame([(one["epoch"], account(1)), (one["epoch"], account(2)), (two["epoch"], account(3)), (5, account(4))], f"epoch bigint, account_rewards {rewrites.REWARDS}")
    dry = rewrites.inject_rewards(spark, str(tmp_path), events, 1000, dry_run=True)
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before
    report = {r["epoch"]: (r["before"], r["after"]) for r in rewrites.inject_rewards(spark, str(tmp_path), events, 1000, suffix="").collect()}
    assert report == {r["epoch"]: (r["before"], r["after"]) for r in dry.collect()}
    n = {b["epoch"]: len(b["pos_rewards"]) for b in (one, two)}
    assert report == {one["epoch"]: (n[one["epoch"]], n[one["epoch"]] + 2), two["epoch"]: (n[two["epoch"]], n[two["epoch"]] + 1), 5: (None, None)}
    after = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert set(after) == set(before) and sum(after[x] != before[x] for x in before) == 2
    got = {bytes(r["hash"]): r.asDict(recursive=True) for r in spark.read.format("epochpack").option("posFrom", 1000).load(str(tmp_path)).collect()}
    for b in (b for *_, bs in groups for b in bs):
        added = {one["hash"]: [1, 2], two["hash"]: [3]}.get(b["hash"], [])
        want = [*(x["execution_epoch_hash"] for x in b["pos_rewards"]), *[b["hash"]] * len(added)]
        mine = got[b["hash"]]
        assert [bytes(x["execution_epoch_hash"]) for x in mine["pos_rewards"]] == want and len(mine["transactions"]) == len(b["transactions"]) and len(mine["unlock_events"]) == len(b["unlock_events"])
        assert [bytes(x["account_rewards"][0]["address"]) for x in mine["pos_rewards"][len(b["pos_rewards"]) :]] == [A[i] for i in added]
    assert containers.verify_packets(containers.read_groups(spark, str(tmp_path))).where("problem is not null").count() == 0


def test_damaged_packets_are_reported(spark):
    """Random damage is a ValueError or none, never another error; a job over damaged packets ends."""
    r = random.Random(12)
    sound = [packets.encode(packet(s, 25, 1010), b"h" * 32, b"s" * 32, 1) for s in range(4)]
    damaged = []
    for _ in range(2000):
        data = bytearray(r.choice(sound))
        for _ in range(r.randint(1, 3)):
            data[r.randrange(len(data))] = r.randrange(256)
        damaged.append(bytes(data))
    problems = 0
    for data in damaged:
        try:
            packets.verify(data)
        except ValueError:
            problems += 1
    assert 200 < problems < 2000
    table = spark.createDataFrame([(i, d) for i, d in enumerate(damaged[:400])], "start_epoch bigint, packet binary")
    assert containers.verify_packets(table).count() == 400


def test_references_point_back():
    blocks = packet(3, 12, 10**9)
    blocks[4]["transactions"] = [blocks[4]["transactions"][0] if blocks[4]["transactions"] else transaction(random.Random(1), blocks[4]["epoch"])] * 2
    data = packets.encode(blocks, b"h" * 32, b"s" * 32, 0)
    got = packets.decode(data, 10**9)[1]
    assert all(x is None or x["block_index"] < b["index"] for b in got for x in b["transaction_refs"]) and len(got[4]["transactions"]) == 2


def test_columns_become_the_same_values():
    """Nested columns by whole fields, with nulls at any level, slices and nothing at all."""
    import pyarrow as pa

    tx = pa.struct([("a", pa.binary()), ("n", pa.int64()), ("s", pa.string())])
    kinds = pa.schema([("i", pa.int32()), ("b", pa.binary()), ("t", pa.list_(tx)), ("d", pa.decimal128(26, 0)), ("r", pa.list_(pa.struct([("x", pa.list_(tx)), ("h", pa.binary())])))])
    one = {"a": b"\0" * 20, "n": 1 << 62, "s": "call"}
    lists = [[one, {"a": None, "n": None, "s": None}, None], None, [], [one]]
    rows = [{"i": None if i == 2 else i, "b": [b"", b"ab", None][i % 3], "t": x, "d": None, "r": None if i else [{"x": x, "h": b"h"}, None]} for i, x in enumerate(lists)]
    table = pa.Table.from_pylist(rows, kinds)
    for part in (table, table.slice(1, 2), table.slice(3), table.slice(0, 0), kinds.empty_table(), pa.concat_tables([table, table])):
        assert packets.rows(part) == part.to_pylist()


def test_many_groups_share_tasks(spark, tmp_path, monkeypatch):
    """Beyond some number of groups, neighbours of a file are read together, each still once and alone in memory."""
    groups = container_folder(spark, tmp_path, per_file=3)
    schema = containers.ContainerSource({}).schema()
    from pyspark.sql.types import StructType

    kinds = spark.createDataFrame([], schema).schema
    assert isinstance(kinds, StructType)
    monkeypatch.setattr(containers, "ALONE", 2)
    reader = containers._Reader({"path": str(tmp_path), "posFrom": "1000"}, kinds)
    parts = reader.partitions()
    assert len(parts) == len({p.name for p in parts}) < len(groups)
    got = [(r["start_epoch"], r["index"], r["hash"]) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(got) == sorted((s, b["index"], b["hash"]) for s, _, _, bs in groups for b in bs)


def test_rewards_leave_other_payloads_alone(monkeypatch):
    """Only payloads of pivots with events are decoded and made anew; the packet is what encoding all blocks again makes."""
    blocks = packet(5, 40, 1010)
    data = packets.encode(blocks, b"h" * 32, b"s" * 32, 7)
    pivots = [b for b in blocks if b["flags"] & 2]
    more = [[{"address": A[i], "pos_identifier": b"p" * 32, "reward": bytes([9])}] for i in range(3)]
    events = [{"epoch": pivots[k]["epoch"], "account_rewards": x} for k, x in zip((0, 0, 2), more, strict=True)] + [{"epoch": 5, "account_rewards": more[0]}]
    whole = []
    monkeypatch.setattr(packets, "_read_items", lambda *a: whole.append(a))
    out, counts = rewrites.injected(data, events, 1010)
    monkeypatch.undo()
    assert not whole and counts == {pivots[k]["epoch"]: (len(pivots[k]["pos_rewards"]), len(pivots[k]["pos_rewards"]) + n) for k, n in ((0, 2), (2, 1))}
    head, got = packets.decode(data, 1010)
    for e in events:
        for b in got:
            if b["flags"] & 2 and b["epoch"] == e["epoch"]:
                b["pos_rewards"] = [*b["pos_rewards"], {"account_rewards": e["account_rewards"], "execution_epoch_hash": b["hash"]}]
    assert out == packets.encode(got, b"h" * 32, b"s" * 32, 7, head["pos_entries"], head)
    assert rewrites.injected(data, events[3:], 1010) == (data, {})


def test_packets_of_columns(spark):
    """A table in any order of rows gives the packet of its blocks; numbers at the ends of their ranges."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(spark.createDataFrame([], packets.BLOCK).schema)
    for most in (0, (1 << 62) - 1, 1 << 62, (1 << 80) - 1):
        blocks = packet(6, 30, 1010)
        for i, b in enumerate(blocks):
            b |= {"base_reward": most if i == 3 else i, "gas_limit": (1 << 54) - 1 if i == 4 else b["gas_limit"], "blame": (1 << 63) - 1 if i == 5 else 127 + i % 2, "base_price_core": (1 << 38) - i % 2}
        table = pa.Table.from_pylist(blocks, kinds).take(list(range(29, -1, -1)))
        data = packets.encode_columns(packets.of_table(table), b"h" * 32, b"s" * 32, 0)
        assert data == packets.encode(blocks, b"h" * 32, b"s" * 32, 0)
        for b, g in zip(blocks, packets.decode(data, 1010)[1], strict=True):
            assert all(b[k] == g[k] for k in ("base_reward", "gas_limit", "blame", "base_price_core", "pos_view", "hash"))
    for change in ({"blame": -1}, {"gas_limit": 1 << 54}, {"base_reward": 1 << 86}, {"finalized_epoch": 1 << 64}):
        with pytest.raises(ValueError):
            packets.encode([blocks[0] | change, *blocks[1:]], b"h" * 32, b"s" * 32, 0)


def test_block_rows_come_from_columns(spark, monkeypatch):
    """Packets become rows without a dict a block; base rewards may be wider than a long."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(spark.createDataFrame([], containers.SCHEMA).schema)
    monkeypatch.setattr(packets, "decode", None)
    for most in (1 << 79, 9):
        blocks = [b | {"base_reward": min(b["base_reward"], most)} for b in packet(7, 20, 1010)]
        got = containers.block_batch(1000, packets.encode(blocks, b"h" * 32, b"s" * 32, 0), 1010, kinds).to_pylist()
        names = ("epoch", "index", "hash", "author", "difficulty", "base_reward", "pos_view", "transactions", "pos_rewards", "unlock_events")
        assert [[g[k] for k in names] for g in got] == [[b[k] for k in names] for b in blocks] and {g["start_epoch"] for g in got} == {1000}
