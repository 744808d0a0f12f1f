import random

import pytest
from pyspark.sql import functions as F

from epochweave.functions.keccak import EMPTY, keccak
from epochweave.state import keys, layers, merkle
from epochweave.state.manager import LayeredState, MemoryStore, ParquetStore, StateManager

OPS = "seq bigint, kind string, address binary, suffix binary, space string, value binary"


def ops(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], OPS)


def account(n: int, value: bytes | None, space: str = "native"):
    return ("account", bytes([n]) * 20, None, space, value)


def plain_root(pairs, many, null):
    """Node by node, as the definition says."""
    one = lambda m: many([m])[0]

    def node(ps, start, compress):
        depth = start
        while compress and depth < min(len(ps[0][0]), len(ps[-1][0])) and ps[0][0][depth] == ps[-1][0][depth]:
            depth += 1
        below = {int(c, 16): node(q, depth + 1, True) for c in "0123456789abcdef" if (q := [p for p in ps if p[0][depth : depth + 1] == c])}
        own = [v for k, v in ps if len(k) == depth]
        core = one(merkle.node_message(below, own[0] if own else None, bool(own), null))
        path = ps[0][0][start:depth]
        return one(merkle.path_bytes(path, start) + core) if path else core

    return node(sorted(pairs), 0, False) if pairs else null


def test_roots_agree_with_recursion():
    many = merkle.HASHES["sha256"]
    null, r = many([b""])[0], random.Random(4)
    for _ in range(300):
        letters = [r.randrange(256) for _ in range(r.randint(1, 6))]
        entries = {bytes(r.choice(letters) for _ in range(r.randint(0, 4))): None if r.random() < 0.2 else r.randbytes(3) for _ in range(r.randint(0, 12))}
        assert merkle.root(entries, "sha256") == plain_root([(k.hex(), v) for k, v in entries.items()], many, null)


def test_distributed_root(spark):
    r = random.Random(2)
    entries = {r.randbytes(r.randint(0, 3)): r.randbytes(4) if r.random() < 0.8 else None for _ in range(400)}
    df = spark.createDataFrame(list(entries.items()), "key binary, value binary")
    assert bytes(merkle.merkle_root(df).first()["root"]) == merkle.root(entries)
    assert merkle.root({}) == EMPTY


def prefixed(r: random.Random, n: int) -> dict:
    """Keys with a long common prefix, keys that are prefixes of others, and tombstones."""
    keys_of = lambda: b"\0\0\1" * r.choice([0, 1, 7]) + bytes(r.choice([0, 1, 17, 18, 255]) for _ in range(r.choice([0, 1, 2, 3, 3, 4])))
    return {keys_of(): r.randbytes(3) if r.random() < 0.8 else None for _ in range(n)}


def table_of(spark, entries):
    return spark.createDataFrame(list(entries.items()), "key binary, value binary")


@pytest.mark.parametrize("crowd", [1, 3, 40, 1000])
def test_ranges_of_any_size(spark, crowd):
    """Maps cut into ranges of any number of keys have the same root, group by group."""
    r = random.Random(crowd)
    maps = {i: prefixed(r, n) for i, n in enumerate((0, 1, 2, 150, 60))}
    kv = spark.createDataFrame([(i, k, v) for i, m in maps.items() for k, v in m.items()], "map int, key binary, value binary")
    found = {x["map"]: bytes(x["root"]) for x in merkle.merkle_root(kv, by=["map"], crowd=crowd).collect()}
    assert found == {i: merkle.root(m) for i, m in maps.items() if m}
    assert bytes(merkle.merkle_root(kv.where("map = 3"), crowd=crowd).first()["root"]) == merkle.root(maps[3])
    assert merkle.merkle_root(kv.where("map = 0")).count() == 0


@pytest.mark.parametrize("crowd", [5, 1000])
def test_index_follows_changes(spark, monkeypatch, crowd):
    """New values, tombstones, new and removed keys, that split and join paths: the root of the index is the cold one, and its nodes are those of a new index."""
    monkeypatch.setattr(merkle, "CROWD", crowd)
    monkeypatch.setattr(merkle, "MOST_TABLES", 1)
    r = random.Random(crowd)
    now = prefixed(r, 80)
    index = merkle.Index.of(table_of(spark, now))
    for step in range(3):
        change = prefixed(r, 25)
        gone = r.sample(sorted(now), 20 if step < 2 else len(now))
        rows = [(k, v, False) for k, v in change.items() if k not in gone] + [(k, None, True) for k in gone] + [(b"never there", None, True)]
        if step == 2:
            rows = [x for x in rows if x[2]]
        index.update(spark.createDataFrame(rows, "key binary, value binary, gone boolean"), gone="gone")
        now = {k: v for k, v in now.items() if k not in gone} | {k: v for k, v, g in rows if not g}
        assert index.root == merkle.root(now)
        nodes = lambda i: {x["path"]: (bytes(x["core"]), sorted(k["path"] for k in x["kids"])) for x in i.nodes().collect()}
        assert nodes(index) == (nodes(merkle.Index.of(table_of(spark, now))) if now else {})
    assert index.root == EMPTY and index.update(table_of(spark, {})) == 0
    index.update(table_of(spark, {b"a": b"b"}))
    assert index.root == merkle.root({b"a": b"b"})


def test_index_hashes_paths_only(spark):
    """1 % changes of a map make 1 % times the depth of nodes anew, not all."""
    kv = spark.range(20000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"))
    index = merkle.Index.of(kv)
    some = kv.where(F.crc32("key") % 1000 == 0)
    n, nodes = some.count(), index.nodes().count()
    hashed = index.update(some.withColumn("value", F.lit(b"new")))
    assert 0 < n < 40 and hashed <= 5 * n < nodes / 10
    after = kv.join(some.select("key", F.lit(b"new").alias("fresh")), "key", "left").select("key", F.coalesce("fresh", "value").alias("value"))
    assert index.root == bytes(merkle.merkle_root(after).first()["root"])


def test_key_shapes(spark):
    kinds = ["account", "storage_root", "storage", "code_root", "code", "deposit", "vote"]
    rows = [(k, b"\x07" * 20, b"\x55" * 32 if k in ("storage", "code") else None, s) for k in kinds for s in ("native", "ethereum")]
    df = spark.createDataFrame(rows, "kind string, address binary, suffix binary, space string")
    df = keys.with_delta_keys(df.withColumn("canonical", keys.canonical_key(F.col("kind"), F.col("address"), F.col("suffix"), F.col("space"))), keys.period_padding())
    out = df.withColumn("a", keys.decode_canonical(F.col("canonical"))).withColumn("b", keys.decode_delta(F.col("delta_key"))).collect()
    for r in out:
        want = (r["kind"], r["address"], r["suffix"], r["space"])
        assert tuple(r["a"]) == want and tuple(r["b"]) == want
        assert (r["canonical"][20:21] == b"\x81") == (r["space"] == "ethereum") == (r["delta_key"][32:33] == b"\x81")
    padding = keccak(EMPTY + EMPTY)
    storage = next(r for r in out if r["kind"] == "storage" and r["space"] == "native")
    head = keccak(padding[:12] + b"\x07" * 20)[:12] + b"\x07" * 20
    assert storage["delta_key"] == head + b"data" + keccak(padding + b"\x55" * 32)[4:] + b"\x55" * 32


def test_malformed_keys(spark):
    short = spark.createDataFrame([("account", b"\1\2\3", None, "ethereum")], "kind string, address binary, suffix binary, space string")
    one = keys.with_delta_keys(short.withColumn("c", keys.canonical_key(F.col("kind"), F.col("address"), F.col("suffix"), F.col("space"))), keys.period_padding()).first()
    assert one["c"] == one["delta_key"] == b"\1\2\3"
    for bad in ((b"\x07" * 20 + b"what",), (b"\x07" * 20 + b"\x82data",)):
        with pytest.raises(Exception, match="unknown key"):
            spark.createDataFrame([bad], "k binary").select(keys.decode_canonical(F.col("k"))).collect()
    with pytest.raises(Exception, match="wrong length"):
        spark.createDataFrame([("code", b"\1" * 7, None, "native")], "kind string, address binary, suffix binary, space string").select(keys.canonical_key(F.col("kind"), F.col("address"), F.col("suffix"), F.col("space"))).collect()


def test_layers_model(spark):
    """Reads, deletes and rotations against a plain model of three dicts."""
    r = random.Random(8)
    model = [{}, {}, {}]
    df = spark.createDataFrame([], "layer int, key string, value bigint, is_tombstone boolean")

    def seen(prefix=""):
        out = {}
        for layer in reversed(model):
            out |= {k: v for k, v in layer.items() if k.startswith(prefix)}
        return {k: v for k, v in out.items() if v is not None}

    for step in range(6):
        batch = [(f"{r.randrange(40):02d}", r.randrange(99) if r.random() < 0.7 else None, i) for i in range(15)]
        for k, v, _ in batch:
            model[0][k] = v
        df = layers.put(df, spark.createDataFrame(batch, "key string, value bigint, seq int"), "seq")
        if step % 2:
            df, removed = layers.delete_prefix(df, str(step % 4))
            prefix = str(step % 4)
            assert {x["key"]: x["value"] for x in removed.collect()} == seen(prefix)
            below = {}
            for layer in reversed(model[1:]):
                below |= {k: v for k, v in layer.items() if k.startswith(prefix)}
            model[0] = {k: v for k, v in model[0].items() if not k.startswith(prefix)} | {k: None for k, v in below.items() if v is not None}
        df = spark.createDataFrame(df.collect(), df.schema)
        assert {x["key"]: x["value"] for x in layers.visible(df).collect()} == seen()
        assert {x["key"]: x["value"] for x in layers.get_prefix(df, "1").collect()} == seen("1")
        if step % 3 == 2:
            df = layers.rotate(df)
            model = [{}, model[0], {k: v for k, v in (model[2] | model[1]).items() if v is not None}]
            df = spark.createDataFrame(df.collect(), df.schema)
            assert {x["key"]: x["value"] for x in layers.visible(df).collect()} == seen()


def test_rotation_script(spark):
    """A write reaches the snapshot after two rotations; roots of a commit are those before its rotation."""
    state = LayeredState(spark, 2)
    state.set(ops(spark, [account(1, b"a"), account(2, b"b")]))
    first = state.commit()
    assert first.snapshot_root == first.intermediate_root == EMPTY and first.delta_root != EMPTY
    second = state.commit()
    assert second.delta_root == first.delta_root and state.intermediate_root == first.delta_root
    assert state.delta_padding == keys.period_padding(EMPTY, first.delta_root)
    third = state.commit()
    assert third.delta_root == EMPTY and third.intermediate_root == first.delta_root
    state.commit()
    assert state.snapshot_root == merkle.root({b"\1" * 20: b"a", b"\2" * 20: b"b"}) and state.intermediate_root == EMPTY
    state.set(ops(spark, [account(1, b"")]))
    wanted = spark.createDataFrame([("account", b"\1" * 20, None, "native"), ("account", b"\2" * 20, None, "native")], "kind string, address binary, suffix binary, space string")
    assert [bytes(r["value"]) for r in state.get(wanted).collect()] == [b"b"]
    for _ in range(4):
        state.commit()
    assert state.snapshot_root == merkle.root({b"\2" * 20: b"b"})


def test_prefixes_and_stores(spark, tmp_path):
    manager = StateManager(spark, ParquetStore(f"file://{tmp_path}/s"), 2)
    key = b"\xab\xcd" + b"\x11" * 30
    manager.set(ops(spark, [("storage", b"\5" * 20, key, "native", b"x"), account(5, b"n"), account(5, b"e", "ethereum"), account(6, b"z")]))
    part = lambda compat: manager.get_all_by_prefix("storage", b"\5" * 20, b"\xab\xcd", compat=compat).count()
    assert part(True) == 0 and part(False) == 1
    manager.commit()
    manager.commit()
    manager.commit()
    manager.commit()
    assert part(True) == 1
    assert manager.get_all_by_prefix("account", b"\5" * 20).count() == 3
    again = StateManager(spark, ParquetStore(f"file://{tmp_path}/s"), 2)
    assert again.height == 4 and again.snapshot_root == manager.snapshot_root and again.delta_padding == manager.delta_padding
    again.set(ops(spark, [account(9, b"only delta")]))
    removed = again.delete_all_by_prefix("address_prefix", b"\5")
    assert removed.count() == 3
    assert again.get_all_by_prefix("address_prefix", b"").count() == 1  # the whole delta went, account 6 stays below
    store = MemoryStore()
    memory = StateManager(spark, store, 5)
    memory.set(ops(spark, [account(1, b"a")]))
    memory.commit()
    assert store.load_latest(spark).height == 1


def test_set_order_does_not_matter(spark):
    rows = [account(n, bytes([n])) for n in range(1, 12)]
    roots = set()
    for batch in (rows, rows[::-1]):
        state = LayeredState(spark, 2000)
        state.set(ops(spark, batch))
        roots.add(state.commit().state_root_hash)
    assert len(roots) == 1


def sizes(folder):
    """Bytes of all data files by table."""
    return {p.name: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in folder.iterdir()}


def test_versions_are_manifests(spark, tmp_path):
    """A commit writes tables of its own changes; a dead job's tables and old versions go; a load goes on from the last whole version."""
    store = ParquetStore(f"file://{tmp_path}/s", keep=2)
    manager = StateManager(spark, store, 3)
    r = random.Random(3)
    values = {n: r.randbytes(400) for n in range(1, 200)}
    manager.set(ops(spark, [account(n, v) for n, v in values.items()]))
    manager.commit()
    first = sizes(tmp_path / "s/tables")
    manager.set(ops(spark, [account(1, b"new"), account(2, b"")]))
    second = manager.commit()
    added = {t: n for t, n in sizes(tmp_path / "s/tables").items() if t not in first}
    assert sum(added.values()) < sum(first.values()) / 10 and set(first) <= set(sizes(tmp_path / "s/tables"))
    manager.set(ops(spark, [account(3, b"never saved")]))  # the job dies here
    again = StateManager(spark, store, 3)
    assert again.height == 2 and again.state.cold_roots()[layers.DELTA] == second.delta_root == again.layers[layers.DELTA].root()
    again.delete_all_by_prefix("account", bytes([5]) * 20)
    for _ in range(5):  # over two boundaries
        again.commit()
        assert again.state.cold_roots() == {n: x.root() for n, x in again.layers.items()}
    named = {store._name(t) for x in again.layers.values() for t in (*x.tables, *x.index.tables)}
    assert named <= set(sizes(tmp_path / "s/tables")) and len(list((tmp_path / "s/versions").iterdir())) == 2
    wanted = spark.createDataFrame([("account", bytes([n]) * 20, None, "native") for n in (1, 2, 3, 5)], "kind string, address binary, suffix binary, space string")
    assert sorted(bytes(x["value"]) for x in again.get(wanted).collect()) == sorted([values[3], b"new"])
