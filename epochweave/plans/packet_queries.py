"""Queries of packets, landed records, keys and byte codecs, each with its SQL.

Blocks are events: packets of 2,000, epochs of ten with the last as pivot;
purchases hold one transaction. Customers stand in for keys and raw records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.functions import codec
from epochweave.operators import checks, epochs
from epochweave.plans.extract import packet_heads as heads_of
from epochweave.plans.queries import PACKET, query
from epochweave.session import materialize, table
from epochweave.sources import containers, records
from epochweave.state import keys, layers

NEVER = (1 << 63) - 1


def _reversed_bytes(c) -> F.Column:
    pairs = F.regexp_extract_all(c, F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


@query("SELECT c_custkey, c_custkey * 65536 + c_nationkey AS value FROM customer")
def little_endian_reads(spark, d):
    c = table(spark, d, "customer")
    raw = _reversed_bytes(F.lpad(F.hex(F.col("c_custkey") * 65536 + F.col("c_nationkey")), 16, "0"))
    return c.select("c_custkey", codec.little_endian(raw).alias("value"))


@query("SELECT p_partkey, ((p_size + 7) // 8 * 8)::INTEGER AS size8, ((p_partkey + 3) // 4 * 4)::BIGINT AS size4 FROM part")
def aligned_sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", codec.aligned(F.col("p_size"), 8).cast("int").alias("size8"), codec.aligned(F.col("p_partkey"), 4).cast("long").alias("size4"))


@query("SELECT p_partkey, hex(encode(p_brand)) AS digits, p_brand AS back FROM part")
def nibble_keys(spark, d):
    digits = codec.nibbles(F.encode("p_brand", "UTF-8"))
    return table(spark, d, "part").select("p_partkey", digits.alias("digits"), F.decode(codec.from_nibbles(digits), "UTF-8").alias("back"))


@query("SELECT c.c_custkey, count(*)::BIGINT AS n FROM customer c JOIN customer o ON starts_with(o.c_custkey::VARCHAR, c.c_custkey::VARCHAR) WHERE c.c_custkey < 100 GROUP BY 1")
def prefix_ranges(spark, d):
    """Keys under a prefix are a range in nibble space: up to, not including, what follows it. The wanted prefixes are few and known."""
    c = table(spark, d, "customer").select("c_custkey", F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("key"))
    lead = F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n)))
    wanted = c.where("c_custkey < 100").select("c_custkey", F.col("key").alias("prefix"))
    met = c.select("key", lead.alias("prefix")).join(wanted, "prefix")
    inside = (F.lower(F.hex("key")) >= F.lower(F.hex("prefix"))) & (F.lower(F.hex("key")) < codec.prefix_end(F.col("prefix")))
    return met.where(inside).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, lpad(to_hex(c_custkey), 8, '0') || repeat('0', 56) AS padded FROM customer")
def padded_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.hex(codec.padded_hash(F.unhex(F.lpad(F.hex("c_custkey"), 8, "0")))).alias("padded"))


@query("SELECT o_orderkey, lpad(to_hex(o_orderkey * 1000000000000), 64, '0') AS wide FROM orders")
def decimal_rewards(spark, d):
    digits = (F.col("o_orderkey") * 1000000000000).cast("string")
    return table(spark, d, "orders").select("o_orderkey", F.hex(records.decimal_bytes(digits)).alias("wide"))


@query("SELECT o_orderkey AS version, lpad(to_hex(o_custkey), 64, '0') AS identifier, o_custkey * 3 AS unlocked FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 AND o_orderstatus = 'P'")
def unlock_decode(spark, d):
    """Raw events of one key become (version, identifier, unlocked); others, and those of another length, are dropped."""
    o = table(spark, d, "orders")
    identifier = F.unhex(F.lpad(F.hex("o_custkey"), 64, "0"))
    data = F.concat(identifier, _reversed_bytes(F.lpad(F.hex(F.col("o_custkey") * 3), 16, "0")))
    raw = o.select(F.col("o_orderkey").alias("version"), F.encode("o_orderstatus", "UTF-8").alias("key"), F.when(F.col("o_orderstatus") == "O", F.substring(data, 1, 5)).otherwise(data).alias("data"))
    out = records.unlock_events(raw, b"P", 100, 5000)
    return out.select("version", F.hex("identifier").alias("identifier"), "unlocked")


@query("SELECT user_id AS execution_hash, max(event_id) AS pos_epoch, max_by(event_type, event_id) AS kind FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY 1")
def latest_rewards(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("execution_hash"), F.col("event_id").alias("pos_epoch"), F.col("event_type").alias("kind"))
    pivots = table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("hash"))
    return records.latest_rewards(e, pivots)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'error')")
def point_reads(spark, d):
    wanted = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("o_orderkey"))
    return records.point_get(table(spark, d, "orders").select("o_orderkey", "o_custkey"), wanted, "o_orderkey")


@query("SELECT event_id // 10 AS epoch, count(*)::INTEGER AS n_executed, (count(*) FILTER (event_type = 'click'))::INTEGER AS n_skipped FROM events GROUP BY 1")
def epoch_sets(spark, d):
    """Executed sets must be there; a missing skipped set is empty."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("epoch"), codec.big_endian32(F.col("event_id")).alias("hash"), "event_type")
    executed = e.groupBy("epoch").agg(F.collect_list("hash").alias("executed"))
    skipped = e.where("event_type = 'click'").groupBy("epoch").agg(F.collect_list("hash").alias("skipped"))
    sets = records.required_sets(e.select("epoch").distinct(), executed, skipped)
    return sets.select("epoch", F.size("executed").alias("n_executed"), F.size("skipped").alias("n_skipped"))


@query("SELECT r.i AS epoch FROM range(0, 2000) r(i) WHERE r.i NOT IN (SELECT user_id FROM events)")
def missing_epochs(spark, d):
    return epochs.missing_epochs(table(spark, d, "events").select(F.col("user_id").alias("epoch")), 0, 2000)


@query("""SELECT packet, lpad(to_hex(CASE WHEN packet = 0 THEN 9 ELSE packet * 2000 - 1 END), 64, '0') AS prev_last_hash, lpad(to_hex(CASE WHEN packet = 0 THEN 0 ELSE packet * 200 - 1 END), 64, '0') AS prev_last_deferred_state_root, packet * 2000 + 7 AS first_block_number
FROM (SELECT DISTINCT event_id // 2000 AS packet FROM events)""")
def packet_heads(spark, d):
    """What stands before each packet: the pivot of the epoch before, its state root, and the first block number."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("epoch"), F.floor(F.col("event_id") / PACKET).alias("packet"))
    pivots = e.where("event_id % 10 = 9").select("epoch", codec.big_endian32(F.col("event_id")).alias("hash"))
    tables = {
        "epochs": pivots.select("epoch", F.col("hash").alias("pivot_hash")),
        "headers": pivots.select("hash", codec.big_endian32(F.col("epoch")).alias("deferred_state_root")),
        "contexts": pivots.select("hash", (F.col("epoch") * 10 + 7).alias("start_block_number")),
    }
    heads = heads_of(e, tables)
    return heads.select("packet", F.hex("prev_last_hash").alias("prev_last_hash"), F.hex("prev_last_deferred_state_root").alias("prev_last_deferred_state_root"), "first_block_number")


def _blocks(spark, d, transactions: F.Column | None = None) -> DataFrame:
    """Whole block rows from events; ``transactions`` of their columns take the place of the purchases'."""
    e = table(spark, d, "events")
    epoch, pivot = F.floor(F.col("event_id") / 10), F.col("event_id") % 10 == 9
    address = codec.long20(F.col("user_id"))
    nothing = F.lit(None).cast("binary")
    tx = F.struct(
        F.when(F.col("event_id") % 2 == 0, "native").otherwise("ethereum").alias("space"), F.lit(0).alias("type_id"), address.alias("sender"), F.col("event_id").alias("nonce"), codec.long32(F.lit(20) + F.col("event_id") % 3).alias("gas_price"),
        nothing.alias("priority_price"), F.lit(21000).cast("long").alias("gas"), F.lit("call").alias("action"), address.alias("to"), codec.long32(F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.when(F.col("event_id") % 2 == 0, F.lit(64)).cast("long").alias("storage_limit"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("event_id") / 20)).alias("epoch_height"), F.encode("props", "UTF-8").alias("data"), nothing.alias("access_list_rlp"), nothing.alias("authorization_list_rlp"),
    )
    flags = F.when(pivot, codec.FLAG_PIVOT).otherwise(0) + F.when(F.col("event_type") == "error", codec.FLAG_SKIPPED_EXECUTION).otherwise(0)
    zero = codec.long32(F.lit(0).cast("long"))
    return e.select(
        F.floor(F.col("event_id") / PACKET).alias("packet"), epoch.alias("epoch"), (F.col("event_id") % PACKET).cast("int").alias("index"), codec.long32(F.col("event_id")).alias("hash"),
        zero.alias("deferred_state_root"), zero.alias("deferred_receipts_root"), zero.alias("deferred_logs_bloom_hash"), flags.cast("int").alias("flags"), address.alias("author"),
        F.unix_timestamp("ts").alias("timestamp"), codec.long32(F.col("user_id")).alias("difficulty"), F.when(F.col("event_id") % 2 == 0, 30_000_000).otherwise(F.col("event_id")).cast("long").alias("gas_limit"),
        F.lit(0).cast("long").alias("base_price_core"), F.lit(codec.ESPACE_PRICE).cast("long").alias("base_price_espace"), epoch.alias("height"), (F.col("event_id") % 3).alias("blame"), F.lit(1).cast("long").alias("finalized_epoch"),
        (F.col("event_id") * 1_000_003).cast("decimal(26,0)").alias("base_reward"), F.lit(None).cast("long").alias("pos_view"), (F.when(F.col("event_type") == "purchase", F.array(tx)) if transactions is None else transactions).alias("transactions"),
    )


def _encoded(spark, d) -> DataFrame:
    blocks = _blocks(spark, d)
    first = blocks.groupBy("packet").agg(F.min("epoch").alias("epoch"))
    nothing = codec.long32(F.lit(0).cast("long"))
    heads = materialize(first.select("packet", nothing.alias("prev_last_hash"), nothing.alias("prev_last_deferred_state_root"), (F.col("epoch") * 10).alias("first_block_number")), "heads")
    return materialize(containers.encode_packets(blocks, "packet", heads, heads.count()), "packets")


def _first_bytes(c: str) -> F.Column:
    return F.hex(F.substring(F.col(c), 1, 4))


@query("""SELECT event_id // 2000 * 200 AS start_epoch, event_id // 10 AS epoch, (event_id % 2000)::INTEGER AS index, lpad(to_hex(event_id), 64, '0') AS hash, ((CASE WHEN event_id % 10 = 9 THEN 2 ELSE 0 END) + (CASE WHEN event_type = 'error' THEN 32 ELSE 0 END) + (CASE WHEN event_type = 'purchase' THEN 8 ELSE 0 END))::INTEGER AS flags,
lpad(to_hex(user_id), 40, '0') AS author, epoch_us(ts) // 1000000 AS timestamp, CASE WHEN event_id % 2 = 0 THEN 30000000 ELSE event_id END::BIGINT AS gas_limit, 20000000000 AS base_price_espace, event_id % 3 AS blame, event_id * 1000003 AS base_reward FROM events""")
def packet_blocks(spark, d):
    """Blocks written to packets and read back, but for their transactions and payload sizes."""
    back = containers.decode_packets(_encoded(spark, d), NEVER)
    flags = F.col("flags").bitwiseAND(~codec.FLAG_TX_COMPRESSED)
    return back.select("start_epoch", "epoch", "index", F.hex("hash").alias("hash"), flags.alias("flags"), F.hex("author").alias("author"), "timestamp", "gas_limit", "base_price_espace", "blame", F.col("base_reward").cast("long").alias("base_reward"))


@query("""SELECT event_id // 10 AS epoch, (event_id % 2000)::INTEGER AS block_index, CASE WHEN event_id % 2 = 0 THEN 'native' ELSE 'ethereum' END AS space, lpad(to_hex(user_id), 40, '0') AS sender, event_id AS nonce, lpad(to_hex(20 + event_id % 3), 64, '0') AS gas_price, CASE WHEN event_id % 2 = 0 THEN event_id // 20 END AS epoch_height, props AS data
FROM events WHERE event_type = 'purchase'""")
def packet_transactions(spark, d):
    """Transactions written to packets, against dictionaries of addresses, prices and nonces, and read back."""
    txs = containers.transactions(containers.decode_packets(_encoded(spark, d), NEVER))
    return txs.select("epoch", "block_index", "space", F.hex("sender").alias("sender"), "nonce", F.hex("gas_price").alias("gas_price"), "epoch_height", F.decode("data", "UTF-8").alias("data"))


@query("SELECT event_id // 2000 * 200 AS start_epoch, count(*)::BIGINT AS blocks, (count(*) FILTER (event_type = 'purchase'))::BIGINT AS tx_blocks, (count(*) FILTER (event_type = 'purchase'))::BIGINT AS tx_items FROM events GROUP BY 1")
def packet_verify(spark, d):
    return containers.verify_packets(_encoded(spark, d)).where("problem is null").select("start_epoch", "blocks", "tx_blocks", "tx_items")


@query("SELECT DISTINCT event_id // 2000 * 200 AS start_epoch, true AS equal FROM events")
def packet_roundtrip(spark, d):
    return records.roundtrip(_encoded(spark, d), NEVER).select("start_epoch", "equal")


@query("""SELECT event_id // 2000 * 200 AS start_epoch, count(DISTINCT event_id // 10)::BIGINT AS epochs, count(*)::BIGINT AS blocks, (count(*) FILTER (event_type = 'purchase'))::BIGINT AS txs, 0::BIGINT AS duplicates,
(count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 0))::BIGINT AS native, (count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 1))::BIGINT AS espace FROM events GROUP BY 1""")
def packet_replay(spark, d):
    """Counts of a replay over packets; blocks without transactions count."""
    return checks.replay_counts(containers.decode_packets(_encoded(spark, d), NEVER))


@query("SELECT event_id // 2000 * 200 AS start_epoch, event_id % 2000 AS index, 'transaction flag' AS problem FROM events WHERE event_type = 'purchase'")
def packet_replay_problems(spark, d):
    """Blocks as they are before encoding, when no flag yet says that they hold transactions."""
    return checks.replay_problems(_blocks(spark, d).withColumn("start_epoch", F.col("packet") * 200)).select("start_epoch", "index", "problem")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'account' WHEN 1 THEN 'storage_root' ELSE 'code' END AS kind, lpad(to_hex(c_custkey), 40, '0') AS address, CASE WHEN c_custkey % 3 = 2 THEN lpad(to_hex(c_nationkey::BIGINT), 64, '0') END AS suffix, CASE WHEN c_custkey % 2 = 0 THEN 'native' ELSE 'ethereum' END AS space FROM customer""")
def decoded_keys(spark, d):
    c, key = table(spark, d, "customer"), _canonical()
    found = c.select("c_custkey", keys.decode_canonical(key).alias("k"))
    return found.select("c_custkey", "k.kind", F.hex("k.address").alias("address"), F.hex("k.suffix").alias("suffix"), "k.space")


def _parts() -> tuple[F.Column, F.Column, F.Column, F.Column]:
    kind = F.when(F.col("c_custkey") % 3 == 0, "account").when(F.col("c_custkey") % 3 == 1, "storage_root").otherwise("code")
    suffix = F.when(kind == "code", F.unhex(F.lpad(F.hex("c_nationkey"), 64, "0")))
    return kind, F.unhex(F.lpad(F.hex("c_custkey"), 40, "0")), suffix, F.when(F.col("c_custkey") % 2 == 0, "native").otherwise("ethereum")


def _canonical() -> F.Column:
    return keys.canonical_key(*_parts())


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'account' WHEN 1 THEN 'storage_root' ELSE 'code' END AS kind, lpad(to_hex(c_custkey), 40, '0') AS address, CASE WHEN c_custkey % 2 = 0 THEN 'native' ELSE 'ethereum' END AS space FROM customer""")
def decoded_delta_keys(spark, d):
    """Per-period keys, with their hashed heads, back to kind, address and space."""
    names = ("kind", "address", "suffix", "space")
    c = table(spark, d, "customer").select("c_custkey", *(x.alias(n) for n, x in zip(names, _parts(), strict=True)))
    found = keys.with_delta_keys(c, keys.period_padding()).select("c_custkey", keys.decode_delta(F.col("delta_key")).alias("k"))
    return found.select("c_custkey", "k.kind", F.hex("k.address").alias("address"), "k.space")


@query("""WITH ops AS (SELECT user_id, max_by(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, event_id) AS v FROM events GROUP BY 1),
old AS (SELECT c_custkey AS k, c_mktsegment AS v, c_custkey % 3 AS layer FROM customer)
SELECT layer::INTEGER AS layer, k AS key, v AS value, false AS is_tombstone FROM old WHERE layer <> 0 OR k NOT IN (SELECT user_id FROM ops)
UNION ALL SELECT 0, user_id, v, v = '' FROM ops""")
def layered_put(spark, d):
    """The last write of each key goes to the delta; an empty value is a tombstone; lower layers stay."""
    c = table(spark, d, "customer")
    state = c.select((F.col("c_custkey") % 3).cast("int").alias("layer"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("is_tombstone"))
    ops = table(spark, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("value"), "event_id")
    return layers.put(state, ops, "event_id").select("layer", "key", "value", "is_tombstone")
