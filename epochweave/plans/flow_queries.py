"""Queries of whole flows: containers written, patched and read again, states over periods, Merkle roots, each with its SQL.

Files and states lie in folders of their own in the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.functions import codec
from epochweave.functions.codec import rlp
from epochweave.plans.extract import Chain, extract_blocks, grouped_epochs, packet_heads
from epochweave.plans.packet_queries import NEVER, _blocks, _encoded
from epochweave.plans.queries import query
from epochweave.session import materialize, shared_dir, table
from epochweave.sources import containers, rewrites
from epochweave.state import merkle
from epochweave.state.manager import ParquetStore, StateManager


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/epochweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _containers(spark, d) -> str:
    """A folder of containers with the packets of all events, ten to a file."""
    containers.register(spark)
    path = _folder(spark, "containers")
    jobs = _encoded(spark, d).withColumn("job", F.floor(F.col("start_epoch") / 2000))
    containers.build_containers(jobs).write.format("epochpack").mode("append").save(path)
    return path


def _rewards(spark, d) -> DataFrame:
    """Orders as block rewards: every third customer's are zero, and blocks without an order have none."""
    return table(spark, d, "orders").select(codec.long32(F.col("o_orderkey")).alias("hash"), (F.col("o_custkey") % 3).alias("total_reward"))


_ZERO = "SELECT event_id, coalesce(o_custkey % 3, 0) = 0 AS zero FROM events LEFT JOIN orders ON o_orderkey = event_id"


@query(f"SELECT lpad(to_hex(event_id), 64, '0') AS hash, (event_id // 2000 * 200)::BIGINT AS start_epoch, zero FROM ({_ZERO})")
def flags_in_files(spark, d):
    """Zero-reward flags set in container files where they lie, and read back from the records alone."""
    path = _containers(spark, d)
    rewrites.patch_zero_rewards(spark, path, _rewards(spark, d))
    sites = spark.read.format("epochpack").option("columns", "flags").load(path)
    return sites.select(F.hex("hash").alias("hash"), "start_epoch", (F.col("flags").bitwiseAND(codec.FLAG_ZERO_TOTAL_REWARD) != 0).alias("zero"))


@query(f"""WITH z AS ({_ZERO}), f AS (SELECT event_id // 20000 AS file, bool_or(zero) AS hit FROM z GROUP BY 1)
SELECT run, files AS files_scanned, CASE WHEN run = 'patch' THEN hits ELSE 0 END AS files_changed, blocks AS blocks_total, flagged AS blocks_flagged
FROM (SELECT count(*)::BIGINT AS files, (count(*) FILTER (hit))::BIGINT AS hits FROM f), (SELECT count(*)::BIGINT AS blocks, (count(*) FILTER (zero))::BIGINT AS flagged FROM z), (VALUES ('patch'), ('again')) t(run)""")
def flag_patch_runs(spark, d):
    """What a patch of containers reports, and that a second one changes no file."""
    path, found = _containers(spark, d), []
    for run in ("patch", "again"):
        r = rewrites.patch_zero_rewards(spark, path, _rewards(spark, d))
        found.append((run, r["files_scanned"], r["files_changed"], r["blocks_total"], r["blocks_flagged"]))
    return spark.createDataFrame(found, "run string, files_scanned bigint, files_changed bigint, blocks_total bigint, blocks_flagged bigint")


@query("""WITH o AS (SELECT o_orderkey // 4 AS epoch, count(*)::INTEGER AS n_rewards, max(o_custkey) AS most FROM orders GROUP BY 1)
SELECT e.event_id // 10 AS epoch, lpad(to_hex(e.event_id), 64, '0') AS hash, n_rewards, lpad(to_hex(most), 64, '0') AS most FROM events e JOIN o ON o.epoch = e.event_id // 10 WHERE e.event_id % 10 = 9""")
def rewards_in_files(spark, d):
    """Reward events injected into the pivots of their epochs, in containers written anew, and read back under the pivots' hashes."""
    path = _containers(spark, d)
    o = table(spark, d, "orders")
    account = F.struct(codec.long20(F.col("o_custkey")).alias("address"), codec.long32(F.col("o_orderkey")).alias("pos_identifier"), codec.long32(F.col("o_custkey")).alias("reward"))
    events = o.select(F.floor(F.col("o_orderkey") / 4).alias("epoch"), F.array(account).alias("account_rewards"))
    rewrites.inject_rewards(spark, path, events, NEVER, suffix="").count()
    back = spark.read.format("epochpack").option("posFrom", NEVER).load(path).where(F.size("pos_rewards") > 0)
    under = F.array_min(F.transform("pos_rewards", lambda r: F.hex(r["execution_epoch_hash"])))
    most = F.array_max(F.transform("pos_rewards", lambda r: F.hex(r["account_rewards"][0]["reward"])))
    return back.select("epoch", under.alias("hash"), F.size("pos_rewards").alias("n_rewards"), most.alias("most"))


_STATUS = ("F", "O", "P")


@query("""WITH w AS (SELECT o_custkey, max_by(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END, (o_orderstatus, o_orderkey)) AS value FROM orders GROUP BY 1)
SELECT lpad(to_hex(o_custkey), 40, '0') AS address, value FROM w WHERE value <> ''""")
def state_over_periods(spark, d):
    """Batches of writes, a commit and a saved version after each, layers that move on every second commit: what a reload of the last version reads."""
    store = ParquetStore(_folder(spark, "state"))
    manager = StateManager(spark, store, period=2)
    o = table(spark, d, "orders")
    for status in _STATUS:
        value = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(b"")).otherwise(F.encode("o_orderpriority", "UTF-8"))
        ops = o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("seq"), F.lit("account").alias("kind"), codec.long20(F.col("o_custkey")).alias("address"), F.lit(None).cast("binary").alias("suffix"), F.lit("native").alias("space"), value.alias("value"))
        manager.set(ops)
        manager.commit()
    again = StateManager(spark, store, period=2)
    return again.get_all_by_prefix("address_prefix", b"").select(F.hex("key").alias("address"), F.decode("value", "UTF-8").alias("value"))


_NULL_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: The root of customers under the bytes of their decimal numbers: keys that are prefixes of others, tombstones. Branches are the common prefixes of
#: neighbours; a step of the recursion makes all nodes of one depth, deepest first, from the kids that hang on them.
_CUSTOMER_ROOT = f"""
WITH RECURSIVE kv AS (SELECT lower(hex(encode(c_custkey::VARCHAR))) AS path, CASE WHEN c_mktsegment <> 'BUILDING' THEN hex(encode(c_name)) ELSE '' END AS value FROM customer),
near AS (SELECT path, lag(path) OVER (ORDER BY path) AS before FROM kv),
branches AS (SELECT DISTINCT path FROM (SELECT '' AS path UNION ALL SELECT list_max([substr(path, 1, n::INTEGER) FOR n IN range(0, length(path) + 1) IF starts_with(before, substr(path, 1, n::INTEGER))]) FROM near WHERE before IS NOT NULL)),
items AS (SELECT path, path AS own, true AS leaf FROM kv UNION ALL SELECT path, NULL, false FROM branches WHERE path <> ''),
parents AS (SELECT i.path, i.leaf, max_by(b.path, length(b.path)) AS parent FROM items i JOIN branches b ON starts_with(i.path, b.path) AND (i.leaf OR b.path <> i.path) GROUP BY ALL),
forest AS (
  SELECT (SELECT max(length(path)) FROM branches) AS depth, p.path, p.leaf, p.parent, sha256(unhex('6E' || repeat('{_NULL_HASH}', 16) || '76' || value)) AS core, value FROM kv JOIN parents p ON p.path = kv.path AND p.leaf
  UNION ALL
  SELECT any_value(s.depth) - 1, s.at, any_value(CASE WHEN s.made THEN false ELSE s.leaf END), any_value(CASE WHEN s.made THEN coalesce(q.parent, 'top') ELSE s.parent END),
    CASE WHEN any_value(s.made) THEN sha256(unhex('6E' || list_aggregate(list_transform(range(16), lambda d: coalesce(list_extract(map_extract(map_from_entries(list(row(s.slot, s.wrapped)) FILTER (s.slot IS NOT NULL)), d), 1), '{_NULL_HASH}')), 'string_agg', '')
      || CASE WHEN count(*) FILTER (s.made AND s.slot IS NULL) > 0 THEN '76' || max(s.value) FILTER (s.slot IS NULL) ELSE '' END)) ELSE any_value(s.core) END,
    any_value(s.value)
  FROM (
    SELECT *, CASE WHEN made AND length(path) > depth THEN strpos('0123456789abcdef', substr(path, depth::INTEGER + 1, 1)) - 1 END AS slot,
      CASE WHEN length(path) > depth + 1 THEN sha256(unhex(printf('%02x', (128 + 64 * ((depth + 1) % 2) + (length(path) - depth - 1) % 256 % 63)::INTEGER)
        || CASE WHEN (depth + 1) % 2 = 1 THEN '0' || substr(path, depth::INTEGER + 2, 1) || substr(path, depth::INTEGER + 3) || CASE WHEN (length(path) - depth - 2) % 2 = 1 THEN '0' ELSE '' END
           ELSE substr(path, depth::INTEGER + 2) || CASE WHEN (length(path) - depth - 1) % 2 = 1 THEN '0' ELSE '' END END || core)) ELSE core END AS wrapped
    FROM (SELECT *, parent <> 'top' AND length(parent) = depth AS made, CASE WHEN parent <> 'top' AND length(parent) = depth THEN parent ELSE path END AS at FROM forest)
  ) s LEFT JOIN parents q ON q.path = s.at AND NOT q.leaf
  WHERE s.depth >= 0 GROUP BY s.at, CASE WHEN s.made THEN false ELSE s.leaf END
)
SELECT core AS root FROM forest WHERE depth = -1
"""


def _customer_kv(spark, d) -> DataFrame:
    value = F.when(F.col("c_mktsegment") != "BUILDING", F.encode("c_name", "UTF-8"))
    return table(spark, d, "customer").select(F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("key"), value.alias("value"))


@query(_CUSTOMER_ROOT)
def merkle_root_customers(spark, d):
    """The SHA-256 root of a map whose keys are prefixes of each other, with tombstones, made by ranges."""
    return merkle.merkle_root(_customer_kv(spark, d), hash_name="sha256", crowd=200).select(F.lower(F.hex("root")).alias("root"))


@query(_CUSTOMER_ROOT)
def merkle_index_customers(spark, d):
    """The same root by changes: from a map of other values, more keys and fewer ones, to that of the customers."""
    kv = _customer_kv(spark, d)
    odd = F.crc32("key") % 2 == 1
    old = kv.where(F.crc32("key") % 7 > 0).withColumn("value", F.when(odd, F.lit(b"old")).otherwise(F.col("value")))
    more = kv.select(F.concat("key", F.lit(b"0!")).alias("key"), F.lit(b"gone").alias("value"))
    index = merkle.Index.of(old.unionByName(more), hash_name="sha256")
    index.update(more.withColumn("gone", F.lit(True)).unionByName(kv.where(odd | (F.crc32("key") % 7 == 0)).withColumn("gone", F.lit(False))), gone="gone")
    return spark.createDataFrame([(index.root.hex(),)], "root string")


def _landed(spark, d) -> dict[str, DataFrame]:
    """Landed tables from events (blocks, epochs of ten with the last as pivot, clicks left out of execution), orders (rewards) and customers (unlocks)."""
    e, o, c = table(spark, d, "events"), table(spark, d, "orders"), table(spark, d, "customer")
    wide = codec.long32
    i, epoch = F.col("event_id"), F.floor(F.col("event_id") / 10)
    clicked = (F.col("event_type") == "click") & (i % 10 != 9)
    sets = e.groupBy(epoch.alias("epoch")).agg(F.array_sort(F.collect_list(F.when(~clicked, wide(i)))).alias("executed"), F.array_sort(F.collect_list(F.when(clicked, wide(i)))).alias("skipped"))
    last = e.groupBy().agg(F.max(epoch).alias("last")).select(F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 20))).alias("k"))
    address, zero = codec.long20(F.col("user_id")), wide(F.lit(0))
    headers = e.select(wide(i).alias("hash"), epoch.alias("height"), (i % 2 == 0).alias("adaptive"), address.alias("author"), F.unix_timestamp("ts").alias("timestamp"), wide(F.col("user_id")).alias("difficulty"), F.lit(30_000_000).cast("long").alias("gas_limit"), F.lit(0).cast("long").alias("base_price_core"), F.lit(0).cast("long").alias("base_price_espace"), (i % 3).alias("blame"), zero.alias("deferred_state_root"), zero.alias("deferred_receipts_root"), zero.alias("deferred_logs_bloom_hash"), wide(F.floor(epoch / 20)).alias("pos_ref"))
    return {
        "epochs": sets.select("epoch", wide(F.col("epoch") * 10 + 9).alias("pivot_hash"), "executed", "skipped"),
        "headers": headers,
        "bodies": _blocks(spark, d).where("transactions is not null").select("hash", "transactions"),
        "rewards": o.select(wide(F.col("o_orderkey")).alias("hash"), (F.col("o_custkey") % 3).alias("total_reward"), (F.col("o_custkey") * 1000).alias("base_reward")),
        "committed": last.select(wide(F.col("k")).alias("pos_ref"), wide(F.greatest(F.col("k") * 20 - 20, F.lit(0)) * 10 + 9).alias("pivot_decision"), (F.col("k") + 100).alias("view"), (F.col("k") * 30).alias("version")),
        "pos_rewards": o.select(wide(F.col("o_orderkey")).alias("execution_hash"), F.col("o_orderkey").alias("pos_epoch"), F.array(F.struct(codec.long20(F.col("o_custkey")).alias("address"), wide(F.col("o_orderkey")).alias("pos_identifier"), wide(F.col("o_custkey")).alias("reward"))).alias("account_rewards")),
        "unlocks": c.select(F.col("c_custkey").alias("version"), wide(F.col("c_custkey")).alias("identifier"), F.col("c_custkey").alias("unlocked")),
        "contexts": e.where("event_id % 10 = 9").select(wide(i).alias("hash"), (epoch * 10 + 7).alias("start_block_number")),
    }


_EXTRACTED = """WITH b AS (SELECT event_id, event_id // 10 AS epoch, event_id % 10 = 9 AS is_pivot, event_type, CASE WHEN event_id // 10 >= 40 THEN event_id // 10 // 20 END AS k, event_id // 2000 AS packet FROM events),
p AS (SELECT epoch, k * 30 AS version, lag(k * 30) OVER (ORDER BY epoch) AS before FROM b WHERE is_pivot),
u AS (SELECT epoch, count(c_custkey)::INTEGER AS n FROM p LEFT JOIN customer ON c_custkey >= before AND c_custkey < version GROUP BY 1)
SELECT packet, (row_number() OVER (PARTITION BY packet ORDER BY b.epoch, CASE WHEN is_pivot THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END, event_id) - 1)::INTEGER AS index, lpad(to_hex(event_id), 64, '0') AS hash, b.epoch,
((CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN is_pivot THEN 2 ELSE 0 END) + (CASE WHEN is_pivot AND b.epoch % 5 = 0 THEN 4 ELSE 0 END) + (CASE WHEN event_type = 'click' AND NOT is_pivot THEN 32 ELSE 0 END) + (CASE WHEN coalesce(o_custkey % 3, 0) = 0 THEN 64 ELSE 0 END)
  {payload})::INTEGER AS flags,
coalesce(o_custkey * 1000, 0)::BIGINT AS base_reward, CASE WHEN k IS NULL THEN 0 ELSE greatest(0, b.epoch - greatest(k * 20 - 20, 0)) END::BIGINT AS finalized_epoch, k + 100 AS pos_view,
(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::INTEGER AS n_txs, (CASE WHEN is_pivot AND o_orderkey IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS n_rewards, (CASE WHEN is_pivot THEN coalesce(u.n, 0) ELSE 0 END)::INTEGER AS n_unlocks
FROM b LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN u ON u.epoch = b.epoch"""


def _extracted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Blocks of all epochs, and the heads of their packets."""
    tables = _landed(spark, d)
    high = tables["headers"].agg(F.max("height")).first()[0] + 1
    heads = packet_heads(grouped_epochs(tables, 0, high, 200), tables)
    return extract_blocks(tables, Chain(pos_reference_enable_height=40), 0, high, 200), heads


def _shown(blocks: DataFrame, packet) -> DataFrame:
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return blocks.select(packet.alias("packet"), "index", F.hex("hash").alias("hash"), "epoch", F.col("flags").bitwiseAND(~codec.FLAG_TX_COMPRESSED).alias("flags"), F.col("base_reward").cast("long").alias("base_reward"), "finalized_epoch", "pos_view", size("transactions").alias("n_txs"), size("pos_rewards").alias("n_rewards"), size("unlock_events").alias("n_unlocks"))


@query(_EXTRACTED.format(payload=""))
def extracted_blocks(spark, d):
    """The whole extraction over landed tables: order, flags, rewards, decided pivots, PoS rewards and unlocks."""
    return _shown(_extracted(spark, d)[0], F.col("packet"))


@query(_EXTRACTED.format(payload="+ (CASE WHEN event_type = 'purchase' OR (is_pivot AND (o_orderkey IS NOT NULL OR coalesce(u.n, 0) > 0)) THEN 8 ELSE 0 END)"))
def extracted_packets(spark, d):
    """The same blocks after they were encoded to packets, with their heads from the epoch contexts, and decoded again."""
    blocks, heads = _extracted(spark, d)
    heads = materialize(heads, "heads")
    n = heads.count()
    packed = materialize(containers.encode_packets(blocks, "packet", heads, n), "packets")
    return _shown(containers.decode_packets(packed, 40, n), F.floor(F.col("start_epoch") / 200))


_TYPES = {0: ("native", 0), 1: ("native", 1), 2: ("native", 2), 3: ("ethereum", 0), 4: ("ethereum", 1), 5: ("ethereum", 2), 6: ("ethereum", 4)}


@query("""SELECT event_id // 10 AS epoch, CASE WHEN event_id % 7 < 3 THEN 'native' ELSE 'ethereum' END AS space, [0, 1, 2, 0, 1, 2, 4][event_id % 7 + 1]::INTEGER AS type_id, event_id AS nonce, lpad(to_hex(20 + event_id % 3), 64, '0') AS gas_price,
CASE WHEN event_id % 7 IN (2, 5, 6) THEN lpad(to_hex(5 + event_id % 2), 64, '0') END AS priority_price, event_id % 7 NOT IN (0, 3) AS has_access, event_id % 7 = 6 AS has_authorization, CASE WHEN event_id % 7 < 3 THEN event_id % 50 END AS storage_limit, CASE WHEN event_id % 4 = 0 AND event_id % 7 < 6 THEN 'create' ELSE 'call' END AS action FROM events""")
def transaction_kinds(spark, d):
    """Transactions of all seven kinds of both spaces, one in each block, written to packets and read back."""
    i = F.col("event_id")
    space, kind = (F.element_at(F.array(*(F.lit(v) for v in x)), (i % 7 + 1).cast("int")) for x in zip(*_TYPES.values(), strict=True))
    native = space == "native"
    listed = lambda test, items: F.when(test, F.lit(rlp(items)))
    create = (i % 4 == 0) & (i % 7 < 6)
    address = codec.long20(F.col("user_id"))
    tx = F.struct(
        space.alias("space"), kind.alias("type_id"), address.alias("sender"), i.alias("nonce"), codec.long32(F.lit(20) + i % 3).alias("gas_price"), F.when(kind.isin(2, 4), codec.long32(F.lit(5) + i % 2)).alias("priority_price"), F.lit(21000).cast("long").alias("gas"),
        F.when(create, "create").otherwise("call").alias("action"), F.when(~create, address).alias("to"), codec.long32(i).alias("value"), F.when(native, i % 50).alias("storage_limit"), F.when(native, F.floor(i / 10)).alias("epoch_height"), F.lit(b"").alias("data"),
        listed(kind > 0, [[b"a" * 20, [b"k" * 32]]]).alias("access_list_rlp"), listed(kind == 4, [[b"\1", b"a" * 20]]).alias("authorization_list_rlp"),
    )
    blocks = _blocks(spark, d, F.array(tx))
    zero = codec.long32(F.lit(0))
    heads = blocks.select("packet").distinct().select("packet", zero.alias("prev_last_hash"), zero.alias("prev_last_deferred_state_root"), F.lit(0).cast("long").alias("first_block_number"))
    heads = materialize(heads, "heads")
    n = heads.count()
    packed = materialize(containers.encode_packets(blocks, "packet", heads, n), "packets")
    t = containers.transactions(containers.decode_packets(packed, NEVER, n))
    return t.select("epoch", "space", "type_id", "nonce", F.hex("gas_price").alias("gas_price"), F.hex("priority_price").alias("priority_price"), F.col("access_list_rlp").isNotNull().alias("has_access"), F.col("authorization_list_rlp").isNotNull().alias("has_authorization"), "storage_limit", "action")
