import pytest

from epochweave.functions.codec import rlp
from epochweave.sources import containers, ingest, packets, records
from tests.test_packets import packet


def test_unlocks_and_rewards(spark, tmp_path):
    key = b"k" * 40
    raw = [(5, key, b"\1" * 32 + (7).to_bytes(8, "little")), (6, b"x" * 40, b"\1" * 40), (9, key, b"\2" * 40), (7, key, b"short")]
    events = spark.createDataFrame(raw, "version bigint, key binary, data binary")
    assert [tuple(r) for r in records.unlock_events(events, key, 5, 9).collect()] == [(5, b"\1" * 32, 7)]
    big = 12345678901234567890123456789
    (tmp_path / "r.json").write_text('{\n  "execution_epoch_hash": "0x%s",\n  "account_rewards": [\n    {"address": "0x%s", "pos_identifier": "%s", "reward": "%d"},\n    {"address": "%s", "pos_identifier": "0x%s", "reward": "300"}\n  ]\n}\n' % ("ee" * 32, "aa" * 20, "bb" * 32, big, "cc" * 20, "dd" * 32))
    (row,) = records.read_reward_lists(spark, str(tmp_path / "r.json")).collect()
    accounts = row["account_rewards"]
    assert [int.from_bytes(r["reward"], "big") for r in accounts] == [big, 300] and {len(r["reward"]) for r in accounts} == {32}
    assert bytes(accounts[0]["address"]) == b"\xaa" * 20 and bytes(accounts[1]["pos_identifier"]) == b"\xdd" * 32 and bytes(row["execution_epoch_hash"]) == b"\xee" * 32
    pivots = spark.createDataFrame([(b"h",)], "hash binary")
    found = records.latest_rewards(spark.createDataFrame([(b"h", 1, "a"), (b"h", 3, "c"), (b"o", 9, "z")], "execution_hash binary, pos_epoch bigint, x string"), pivots)
    assert [tuple(r) for r in found.collect()] == [(b"h", 3, "c")]


def test_sets_and_points(spark):
    epochs = spark.createDataFrame([(1,), (2,)], "epoch bigint")
    executed = spark.createDataFrame([(1, [b"a"]), (2, [b"b"])], "epoch bigint, executed array<binary>")
    skipped = spark.createDataFrame([(2, [b"c"])], "epoch bigint, skipped array<binary>")
    got = {r["epoch"]: r["skipped"] for r in records.required_sets(epochs, executed, skipped).collect()}
    assert got == {1: [], 2: [b"c"]}
    with pytest.raises(Exception, match="missing"):
        records.required_sets(epochs, executed.where("epoch = 1"), skipped).collect()
    assert records.point_get(executed, spark.createDataFrame([(2,), (2,), (5,)], "epoch bigint"), "epoch").count() == 1


def test_shards_and_roundtrip(spark, tmp_path):
    data = [(1000 * i, 8, packets.encode(packet(i, 8, 1000), b"h" * 32, b"s" * 32, i)) for i in range(3)]
    groups = spark.createDataFrame(data, "start_epoch bigint, epochs bigint, packet binary")
    containers.register(spark)
    records.shard_files(groups).write.format("epochpack").mode("append").save(str(tmp_path))
    back = records.read_shards(spark, str(tmp_path))
    assert sorted((r["start_epoch"], r["end_epoch"]) for r in back.collect()) == [(0, 7), (1000, 1007), (2000, 2007)]
    assert all(r["equal"] for r in records.roundtrip(back, 1000).collect())
    assert not any(r["equal"] for r in records.roundtrip(back, 1 << 62).collect())  # without its PoS views a packet does not come back


def test_raw_headers(spark):
    """A stored header with its proof-of-work hash has its reference one place further on; read the wrong way it is an error, not another reference."""
    field = lambda n: bytes([n]) * 32
    body = [field(1), 77, 1234, b"a" * 20, field(2), field(3), field(4), field(5), 2, 10**15, 1, 30_000_000, [field(6), field(7)], 1 << 255]
    records_of = lambda with_hash, ref: rlp([*body, *([field(9)] if with_hash else []), [ref] if ref else [], [], b"custom"])
    for with_hash in (True, False):
        raw = spark.createDataFrame([(b"x", records_of(with_hash, field(8))), (b"y", records_of(with_hash, None))], "hash binary, value binary")
        x, y = sorted(ingest.headers(raw, pow_hash=with_hash).collect(), key=lambda r: bytes(r["hash"]))
        assert bytes(x["pos_ref"]) == field(8) and y["pos_ref"] is None and x["height"] == 77 and x["adaptive"] and int.from_bytes(x["nonce"], "big") == 1 << 255 and len(x["referee_hashes"]) == 2
        assert (x["pow_hash"] and bytes(x["pow_hash"])) == (field(9) if with_hash else None) and [bytes(v) for v in x["rest"]] == [b"custom"]
    with pytest.raises(ValueError, match="no list"):
        ingest.header(records_of(True, field(8)), pow_hash=False)
    with pytest.raises(Exception, match="cannot be read"):
        ingest.headers(spark.createDataFrame([(b"x", b"\xc1\x01")], "hash binary, value binary")).collect()


def test_bcs_records(spark):
    layout = [("hash_of", "bytes"), ("miner", "option:fixed:4"), ("epoch", "u64"), ("skipped", "bool")]
    value = lambda miner: b"\x03abc" + (b"\1" + miner if miner else b"\0") + (9).to_bytes(8, "little") + b"\1"
    raw = spark.createDataFrame([(b"x", value(b"mine")), (b"y", value(None))], "hash binary, value binary")
    assert sorted((bytes(r["hash"]), bytes(r["hash_of"]), r["miner"] and bytes(r["miner"]), r["epoch"], r["skipped"]) for r in ingest.bcs_records(raw, layout).collect()) == [(b"x", b"abc", b"mine", 9, True), (b"y", b"abc", None, 9, True)]
    for bad in (value(None)[:-1], value(None) + b"x", b"\xff" * 12, value(None)[:-1] + b"\2"):
        with pytest.raises(ValueError):
            ingest.bcs(bad, layout)
