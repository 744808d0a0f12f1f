"""Queries over the driver's tables, one or more per operator, each with its SQL.

Roles: events are blocks (packet: 2,000 event ids; pivot: a purchase), orders
and customers stand in for transactions, rewards and state, part and lineitem
for dictionary values, pages for file names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.functions import codec
from epochweave.operators import checks, dictionaries, epochs, packing
from epochweave.session import table
from epochweave.state import layers, merkle
from epochweave.state.keys import canonical_key

PACKET = 2000
REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("packet", F.floor(F.col("event_id") / PACKET)).withColumn("pivot", F.col("event_type") == "purchase")


_B = "WITH b AS (SELECT *, event_id // 2000 AS packet, event_type = 'purchase' AS is_pivot FROM events)"
_E = _B + """, e AS (SELECT *, first_value(CASE WHEN is_pivot THEN event_id END IGNORE NULLS) OVER (PARTITION BY packet ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS epoch FROM b)"""


@query(_E + " SELECT event_id, epoch FROM e")
def epoch_assign(spark, d):
    return epochs.assign_epochs(blocks(spark, d), "event_id", "pivot", "event_id").select("event_id", "epoch")


@query(_E + " SELECT epoch, count(*)::BIGINT AS n_blocks, min(event_id) AS first_block, max(event_id) AS last_block, count(DISTINCT user_id)::BIGINT AS n_senders FROM e WHERE epoch IS NOT NULL GROUP BY epoch")
def epoch_summary(spark, d):
    e = epochs.assign_epochs(blocks(spark, d), "event_id", "pivot", "event_id").where("epoch is not null")
    return e.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("event_id").alias("first_block"), F.max("event_id").alias("last_block"), F.countDistinct("user_id").alias("n_senders"))


@query(_B + " SELECT event_id, (packet * 10000 + row_number() OVER (PARTITION BY packet ORDER BY event_id) - 1)::BIGINT AS block_number FROM b")
def block_numbers(spark, d):
    return epochs.number_blocks(blocks(spark, d), F.col("packet") * 10000, "event_id").select("event_id", "block_number")


@query("""WITH g AS (SELECT event_id // 10 AS epoch, event_id, event_type = 'error' AS skipped, event_id = max(event_id) OVER (PARTITION BY event_id // 10) AS is_pivot FROM events),
o AS (SELECT *, CASE WHEN is_pivot THEN 2 WHEN skipped THEN 1 ELSE 0 END AS class FROM g)
SELECT epoch, class, CASE WHEN class = 2 THEN 0 ELSE row_number() OVER (PARTITION BY epoch, class ORDER BY event_id) - 1 END::BIGINT AS pos, event_id AS hash FROM o""")
def block_order(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("epoch"), "event_id", "event_type")
    pivot = e.groupBy("epoch").agg(F.max("event_id").alias("pivot_hash"))
    e = e.join(pivot, "epoch")
    skipped = F.when((F.col("event_type") == "error") & (F.col("event_id") != F.col("pivot_hash")), F.col("event_id"))
    executed = F.when((F.col("event_type") != "error") | (F.col("event_id") == F.col("pivot_hash")), F.col("event_id"))
    sets = e.groupBy("epoch", "pivot_hash").agg(F.sort_array(F.collect_list(executed)).alias("executed"), F.sort_array(F.collect_list(skipped)).alias("skipped"))
    return epochs.ordered_blocks(sets).select("epoch", F.col("class"), long("pos").alias("pos"), "hash")


_FLAGS = """(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 4 ELSE 0 END
 + CASE WHEN o_orderstatus = 'P' THEN 32 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 64 ELSE 0 END)"""


def flagged(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    flags = codec.block_flags(F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "F", F.col("o_orderkey"), 5, F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 7 != 0, 1))
    return o.select("o_orderkey", flags.alias("flags"))


@query(f"SELECT o_orderkey, {_FLAGS}::INTEGER AS flags FROM orders")
def flag_pack(spark, d):
    return flagged(spark, d)


@query(f"SELECT o_orderkey, {', '.join(f'(flags // {v}) % 2 = 1 AS {k}' for k, v in codec.FLAGS.items())} FROM (SELECT o_orderkey, {_FLAGS} AS flags FROM orders)")
def flag_unpack(spark, d):
    return flagged(spark, d).select("o_orderkey", *(codec.has_flag(F.col("flags"), k).alias(k) for k in codec.FLAGS))


def framed(spark, d) -> DataFrame:
    return epochs.frame_of_reference(blocks(spark, d).select("packet", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us")), "packet", ["us", "event_id"])


@query(_B + " SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY packet) AS d_us, event_id - min(event_id) OVER (PARTITION BY packet) AS d_event_id FROM b")
def frame_of_reference(spark, d):
    return framed(spark, d).select("event_id", "d_us", "d_event_id")


@query("SELECT event_id // 2000 AS packet, epoch_us(ts) AS us, event_id FROM events")
def frame_decode(spark, d):
    return epochs.decode_frame(framed(spark, d), ["us", "event_id"]).select("packet", "us", "event_id")


@query(_B + " SELECT packet, min(event_id) AS min_index, min(epoch_us(ts)) AS min_us, coalesce(min(CASE WHEN event_type = 'error' THEN user_id END), 0) AS min_view FROM b GROUP BY packet")
def range_minima(spark, d):
    b = blocks(spark, d)
    return b.groupBy("packet").agg(F.min("event_id").alias("min_index"), F.min(F.expr("unix_micros(cast(ts as timestamp))")).alias("min_us"), F.coalesce(F.min(F.when(F.col("event_type") == "error", F.col("user_id"))), F.lit(0)).alias("min_view"))


_DAYS = "SELECT l_orderkey, l_partkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate)::BIGINT - 30 AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, delta, (CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END)::BIGINT AS coded, delta AS decoded FROM ({_DAYS})")
def zigzag_delta(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.withColumn("delta", F.datediff("l_shipdate", "o_orderdate").cast("long") - 30).withColumn("coded", codec.zigzag(F.col("delta")))
    return j.select("l_orderkey", "l_partkey", "l_linenumber", "delta", "coded", codec.unzigzag(F.col("coded")).alias("decoded"))


_BIG = "(o_orderkey * o_orderkey * o_orderkey)"


def _cubed() -> Column:
    """Cubes of order keys, exact for keys of up to 11 digits: a long holds them up to some two million only."""
    key = F.col("o_orderkey").cast("decimal(11,0)")
    return key * key * key


@query(f"SELECT o_orderkey, (CASE {' '.join(f'WHEN {_BIG} < {1 << (7 * n)} THEN {n}' for n in range(1, 9))} ELSE 9 END)::INTEGER AS n FROM orders")
def uleb_length(spark, d):
    """Lengths of cubes. Cubes beyond 64 bits are not cut off first: from 2^56 on the SQL has 9."""
    return table(spark, d, "orders").select("o_orderkey", F.least(codec.uleb_length(_cubed()), F.lit(9)).alias("n"))


@query(f"SELECT o_orderkey, (CASE WHEN v IN (0, 30000000, 60000000) THEN 1 WHEN v < {1 << 38} THEN 5 WHEN v < {1 << 46} THEN 6 WHEN v < {1 << 54} THEN 7 END)::INTEGER AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 30000000 ELSE {_BIG} * 1000 END AS v FROM orders)")
def qc5e_length(spark, d):
    """Lengths of a thousand cubes; those that 54 bits do not hold have none, however large they are."""
    v = F.when(F.col("o_orderkey") % 3 == 0, F.lit(30_000_000)).otherwise(_cubed() * 1000)
    return table(spark, d, "orders").select("o_orderkey", codec.qc5e_length(v, codec.GAS_LIMITS).cast("int").alias("n"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 30000000 WHEN 2 THEN 60000000 ELSE 0 END::BIGINT AS gas_limit,
CASE p_size % 4 WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 20000000000 ELSE 1000000000 END ELSE 0 END::BIGINT AS base_price FROM part""")
def enum_values(spark, d):
    p = table(spark, d, "part")
    code = F.col("p_size") % 4
    return p.select("p_partkey", codec.gas_limit_value(code).alias("gas_limit"), codec.base_price_value(code, F.col("p_partkey") % 2 == 0).alias("base_price"))


@query("SELECT user_id, count(*)::BIGINT AS n, min(event_id) AS first_seen, (row_number() OVER (ORDER BY count(*) DESC, min(event_id)) - 1)::BIGINT AS index FROM events GROUP BY user_id")
def freq_dictionary(spark, d):
    return dictionaries.frequency_table(table(spark, d, "events"), "user_id", "event_id").select("user_id", "n", "first_seen", "index")


@query(_B + """, v AS (SELECT packet, user_id AS value, event_id * 2 AS o FROM b UNION ALL SELECT packet, (event_id % 50), event_id * 2 + 1 FROM b),
g AS (SELECT packet, value, count(*)::BIGINT AS n, min(o) AS first_seen FROM v GROUP BY packet, value HAVING count(*) > 3)
SELECT packet, value, n, first_seen, (row_number() OVER (PARTITION BY packet ORDER BY n DESC, first_seen) - 1)::BIGINT AS index FROM g QUALIFY row_number() OVER (PARTITION BY packet ORDER BY n DESC, first_seen) <= 16""")
def top16_dictionary(spark, d):
    b = blocks(spark, d).withColumn("other", F.col("event_id") % 50)
    both = dictionaries.combined(b, ["user_id", "other"], "event_id", ["packet"])
    return dictionaries.frequency_table(both, "value", "event_id", "packet", more_than=3, most=16).select("packet", "value", "n", "first_seen", "index")


@query(_B + " SELECT packet, user_id, min(event_id) AS first_seen, (row_number() OVER (PARTITION BY packet ORDER BY min(event_id)) - 1)::BIGINT AS index FROM b GROUP BY packet, user_id")
def distinct_first_seen(spark, d):
    return dictionaries.first_seen(blocks(spark, d), "user_id", "event_id", "packet").select("packet", "user_id", "first_seen", "index")


_LEN = lambda v: "(CASE " + " ".join(f"WHEN {v} < {1 << (7 * n)} THEN {n}" for n in range(1, 9)) + " ELSE 9 END)"


@query(_B + f""", n AS (SELECT packet, user_id, event_id + 1000000 AS nonce, min(event_id + 1000000) OVER (PARTITION BY packet, user_id) AS base_nonce FROM b)
SELECT packet, user_id, base_nonce, sum({_LEN("nonce")} - {_LEN("(nonce - base_nonce)")})::BIGINT AS saving FROM n GROUP BY ALL HAVING saving >= 16""")
def sender_base_nonce(spark, d):
    t = blocks(spark, d).withColumn("nonce", F.col("event_id") + 1_000_000)
    return dictionaries.sender_base_nonces(t, "packet", "user_id", "nonce").select("packet", "user_id", "base_nonce", "saving")


@query(_B + f""", n AS (SELECT event_id, packet, user_id, event_id + 1000000 AS nonce, min(event_id + 1000000) OVER (PARTITION BY packet, user_id) AS base_nonce FROM b),
k AS (SELECT packet, user_id, base_nonce FROM n GROUP BY ALL HAVING sum({_LEN("nonce")} - {_LEN("(nonce - base_nonce)")}) >= 16)
SELECT event_id, nonce - coalesce(k.base_nonce, 0) AS nonce_offset FROM n LEFT JOIN k USING (packet, user_id)""")
def nonce_offsets(spark, d):
    t = blocks(spark, d).withColumn("nonce", F.col("event_id") + 1_000_000)
    bases = dictionaries.sender_base_nonces(t, "packet", "user_id", "nonce")
    return dictionaries.nonce_offsets(t, bases, "packet", "user_id", "nonce").select("event_id", "nonce_offset")


_PARTS = "WITH f AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) - 1)::BIGINT AS index FROM part GROUP BY p_brand)"


@query(_PARTS + " SELECT p_partkey, index AS p_brand_index FROM part JOIN f USING (p_brand)")
def dict_encode(spark, d):
    p = table(spark, d, "part")
    return dictionaries.encode(p, dictionaries.frequency_table(p, "p_brand", "p_partkey"), "p_brand").select("p_partkey", "p_brand_index")


@query("SELECT p_partkey, p_brand FROM part")
def dict_decode(spark, d):
    p = table(spark, d, "part")
    words = dictionaries.frequency_table(p, "p_brand", "p_partkey")
    return dictionaries.decode(dictionaries.encode(p, words, "p_brand").drop("p_brand"), words, "p_brand").select("p_partkey", "p_brand")


_REFS = _B + ", r AS (SELECT *, nullif(min(event_id) OVER (PARTITION BY packet, user_id, event_type), event_id) AS ref FROM b)"


@query(_REFS + " SELECT event_id, ref FROM r")
def dup_refs(spark, d):
    return dictionaries.duplicate_references(blocks(spark, d), ["user_id", "event_type"], "event_id", "packet").select("event_id", "ref")


@query(_REFS + " SELECT r.event_id, coalesce(s.user_id, r.user_id) AS user_id, coalesce(s.value, r.value) AS value FROM r LEFT JOIN r s ON r.ref = s.event_id")
def resolve_refs(spark, d):
    r = dictionaries.duplicate_references(blocks(spark, d), ["user_id", "event_type"], "event_id", "packet")
    r = r.withColumns({c: F.when(F.col("ref").isNull(), F.col(c)) for c in ("user_id", "value")})
    return dictionaries.resolve_references(r, "event_id", "packet", ["user_id", "value"]).select("event_id", "user_id", "value")


@query("""SELECT c_custkey, o_orderkey, round(o_totalprice * 100)::BIGINT AS reward FROM customer LEFT JOIN
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey WHERE c_nationkey < 10""")
def reward_semi_attach(spark, d):
    pivots = table(spark, d, "customer").where("c_nationkey < 10").select("c_custkey")
    rewards = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", cents("o_totalprice").alias("reward"))
    return epochs.attach_rewards(pivots, rewards, "c_custkey", "o_orderkey").select("c_custkey", "o_orderkey", "reward")


@query("""WITH p AS (SELECT event_id AS curr, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events WHERE event_type = 'signup')
SELECT curr, prev, count(e.event_id)::BIGINT AS n_unlocks, min(e.event_id) AS first_unlock FROM p JOIN events e ON e.event_type = 'error' AND e.event_id >= prev AND e.event_id < curr GROUP BY ALL""")
def unlock_range_join(spark, d):
    e = blocks(spark, d)
    pivots = e.where("event_type = 'signup'").select("packet", F.col("event_id").alias("curr"))
    carried = epochs.last_of_previous(pivots, "curr", "curr", "packet")
    pivots = epochs.previous_values(pivots, "curr", "curr", "packet", carried).withColumnRenamed("previous_curr", "prev").where("prev is not null").select("curr", "prev")
    points = e.where("event_type = 'error'").select("event_id")
    return epochs.range_join(pivots, points, "prev", "curr", "event_id", 64).groupBy("curr", "prev").agg(F.count(F.lit(1)).alias("n_unlocks"), F.min("event_id").alias("first_unlock"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 500 THEN CASE WHEN n_nationkey IS NULL THEN error('lost') ELSE greatest(0, o_orderkey - n_nationkey * 100) END ELSE 0 END::BIGINT AS finalized_offset FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def finalized_offset(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", epochs.effective_reference(F.col("o_orderkey"), F.col("o_custkey"), 500).alias("pos_ref"))
    committed = table(spark, d, "customer").select(F.col("c_custkey").alias("pos_ref"), F.col("c_nationkey").alias("pivot_decision"))
    headers = table(spark, d, "nation").select(F.col("n_nationkey").alias("hash"), (long("n_nationkey") * 100).alias("height"))
    return epochs.finalized_offset(o, committed, headers, "o_orderkey").select("o_orderkey", "finalized_offset")


@query(_B + ", l AS (SELECT packet, max(event_id) AS last FROM b WHERE is_pivot GROUP BY packet) SELECT p.packet, max(l.last) AS boundary FROM (SELECT DISTINCT packet FROM b) p LEFT JOIN l ON l.packet < p.packet GROUP BY p.packet")
def previous_boundary(spark, d):
    b = blocks(spark, d).withColumn("last", F.when(F.col("pivot"), F.col("event_id")))
    return epochs.last_of_previous(b, "last", "event_id", "packet").select("packet", F.col("last").alias("boundary"))


def state_layers(spark, d) -> DataFrame:
    """Snapshot: customers; intermediate and delta: the last order of each, by even and odd order keys."""
    snap = table(spark, d, "customer").select(F.lit(2).alias("layer"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("key"), cents("c_acctbal").alias("value"), F.lit(False).alias("is_tombstone"))
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 2 == 0).cast("int").alias("layer"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("key"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", cents("o_totalprice")).alias("value"), (F.col("o_orderstatus") == "P").alias("is_tombstone"))
    last = o.groupBy("layer", "key").agg(F.max_by(F.struct("value", "is_tombstone"), "o_orderkey").alias("x")).select("layer", "key", "x.value", "x.is_tombstone")
    return snap.unionByName(last)


_L = """WITH layers AS (SELECT 2 AS layer, lpad(c_custkey::VARCHAR, 9, '0') AS key, round(c_acctbal * 100)::BIGINT AS value, false AS is_tombstone FROM customer UNION ALL
SELECT layer, key, value, is_tombstone FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS layer, lpad(o_custkey::VARCHAR, 9, '0') AS key,
CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice * 100)::BIGINT END AS value, o_orderstatus = 'P' AS is_tombstone, row_number() OVER (PARTITION BY o_orderkey % 2, o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""
_TOP = "(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer) = 1)"


@query(_L + f" SELECT key, value FROM {_TOP.format(t='layers')} WHERE NOT is_tombstone")
def layered_get(spark, d):
    keys = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("key"))
    return layers.get(state_layers(spark, d), keys.unionByName(table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("key"))))


@query(_L + f" SELECT key, value FROM {_TOP.format(t='layers')} WHERE NOT is_tombstone AND key LIKE '0000001%'")
def layered_prefix_get(spark, d):
    return layers.get_prefix(state_layers(spark, d), "0000001")


@query(_L + """ SELECT key, value, layer::INTEGER AS layer, is_tombstone FROM layers WHERE layer <> 0 OR key NOT LIKE '0000001%'
UNION ALL SELECT key, NULL, 0, true FROM (SELECT * FROM layers WHERE layer <> 0 AND key LIKE '0000001%' QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer) = 1) WHERE NOT is_tombstone""")
def prefix_delete(spark, d):
    return layers.delete_prefix(state_layers(spark, d), "0000001")[0].select("key", "value", "layer", "is_tombstone")


@query(_L + """ SELECT key, value, layer::INTEGER AS layer, is_tombstone FROM layers WHERE layer <> 0
UNION ALL SELECT key, NULL, 0, true FROM (SELECT * FROM layers WHERE layer <> 0 AND key LIKE '0000001%' QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer) = 1) WHERE NOT is_tombstone""")
def prefix_delete_compat(spark, d):
    return layers.delete_prefix(state_layers(spark, d), "0000001", whole_delta=True)[0].select("key", "value", "layer", "is_tombstone")


_R1 = _L + f""", r1 AS (SELECT 2 AS layer, key, value, false AS is_tombstone FROM {_TOP.format(t="(SELECT * FROM layers WHERE layer > 0)")} WHERE NOT is_tombstone
UNION ALL SELECT 1, key, value, is_tombstone FROM layers WHERE layer = 0)"""


@query(_R1 + " SELECT layer::INTEGER AS layer, key, value, is_tombstone FROM r1")
def rotate_once(spark, d):
    return layers.rotate(state_layers(spark, d)).select("layer", "key", "value", "is_tombstone")


@query(_R1 + f" SELECT 2::INTEGER AS layer, key, value, false AS is_tombstone FROM {_TOP.format(t='r1')} WHERE NOT is_tombstone")
def rotate_twice(spark, d):
    return layers.rotate(layers.rotate(state_layers(spark, d))).select("layer", "key", "value", "is_tombstone")


_G = "WITH RECURSIVE g AS (SELECT event_id // 1000 AS job, event_id // 100 AS grp, sum(length(props))::BIGINT AS size, count(*)::BIGINT AS n FROM events GROUP BY ALL)"
_P = _G + """, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY grp) AS rn FROM g),
p AS (SELECT job, grp, size, n, rn, 0::BIGINT AS container, 0::BIGINT AS off, size AS filled FROM r WHERE rn = 1
UNION ALL SELECT r.job, r.grp, r.size, r.n, r.rn, CASE WHEN p.filled >= 3000 THEN p.container + 1 ELSE p.container END, CASE WHEN p.filled >= 3000 THEN 0 ELSE p.filled END, CASE WHEN p.filled >= 3000 THEN r.size ELSE p.filled + r.size END
FROM p JOIN r ON r.job = p.job AND r.rn = p.rn + 1)"""


def groups(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.floor(F.col("event_id") / 1000).alias("job"), F.floor(F.col("event_id") / 100).alias("grp")).agg(F.sum(F.length("props")).cast("long").alias("size"), F.count(F.lit(1)).alias("n"))


@query(_P + ' SELECT job, grp, size, container, off AS "offset" FROM p')
def container_pack(spark, d):
    return packing.pack_containers(groups(spark, d), "job", "grp", "size", 3000).select("job", "grp", "size", "container", "offset")


@query(_G + ' SELECT job, grp, coalesce(sum(size) OVER (PARTITION BY job ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM g')
def pack_offsets(spark, d):
    return packing.running_offsets(groups(spark, d), "job", "grp", "size").select("job", "grp", "offset")


@query(_P + " SELECT count(*)::BIGINT AS files, sum(g)::BIGINT AS groups, sum(n)::BIGINT AS blocks, sum(s)::BIGINT AS bytes, floor(avg(s))::BIGINT AS mean_bytes FROM (SELECT job, container, count(*) AS g, sum(n) AS n, sum(size) AS s FROM p GROUP BY ALL)")
def pack_report(spark, d):
    packed = packing.pack_containers(groups(spark, d), "job", "grp", "size", 3000).withColumn("file", F.struct("job", "container"))
    return checks.pack_summary(packed, "file", "n", "n", "size").select("files", "groups", "blocks", "bytes", "mean_bytes")


@query("""WITH l AS (SELECT source, 56 + n_chars // 100 AS n FROM documents), f AS (SELECT source, avg((n <= 64)::INT) AS a, avg((n <= 72)::INT) AS b, avg((n <= 80)::INT) AS c, avg((n <= 88)::INT) AS e FROM l GROUP BY source)
SELECT source, CASE WHEN a >= 0.9 THEN 64 WHEN b >= 0.9 THEN 72 WHEN c >= 0.7 THEN 80 WHEN e >= 0.7 THEN 88 ELSE 96 END::BIGINT AS prefix_size FROM f""")
def prefix_size_choice(spark, d):
    return packing.choose_prefix(table(spark, d, "documents"), 56 + F.floor(F.col("n_chars") / 100), ["source"])


@query("""WITH g AS (SELECT o_orderkey * 10 AS start, 10 AS n FROM orders WHERE o_orderkey % 37 <> 5) SELECT start FROM g WHERE start - 10 NOT IN (SELECT start FROM g) AND start > (SELECT min(start) FROM g)""")
def contiguity_violations(spark, d):
    g = table(spark, d, "orders").where("o_orderkey % 37 <> 5").select((F.col("o_orderkey") * 10).alias("start"), F.lit(10).alias("n"))
    return epochs.contiguity_violations(g, "start", "n").select("start")


@query("""WITH b AS (SELECT event_id // 2000 AS packet, event_id AS idx FROM events WHERE event_id % 999 <> 7), e AS (SELECT *, min(idx) OVER (PARTITION BY packet) + row_number() OVER (PARTITION BY packet ORDER BY idx) - 1 AS expected FROM b)
SELECT packet, idx, expected::BIGINT AS expected FROM e WHERE idx <> expected""")
def index_violations(spark, d):
    b = blocks(spark, d).where("event_id % 999 <> 7").select("packet", F.col("event_id").alias("idx"))
    return epochs.index_violations(b, "idx", "packet").select("packet", "idx", "expected")


@query(_E + """, v AS (SELECT packet, event_id - packet * 2000 AS idx, epoch, event_id % 250 AS flags FROM e)
SELECT packet, idx, problem FROM (SELECT packet, idx, unnest([CASE WHEN flags >= 128 THEN 'reserved flag' END, CASE WHEN epoch IS NULL THEN 'no pivot' END, CASE WHEN (flags // 2) % 2 = 1 AND epoch <> packet * 2000 + idx THEN 'epoch' END]) AS problem FROM v) WHERE problem IS NOT NULL""")
def packet_violations(spark, d):
    e = epochs.assign_epochs(blocks(spark, d), "event_id", "pivot", "event_id")
    v = e.select("packet", (F.col("event_id") - F.col("packet") * PACKET).alias("idx"), "epoch", (F.col("event_id") % 250).alias("flags"), F.col("event_id").alias("height"))
    return checks.packet_violations(v, "packet", "idx").select("packet", "idx", "problem")


@query(_B + " SELECT packet, count(*)::BIGINT AS blocks, count(*) FILTER (user_id % 3 > 0)::BIGINT AS tx_blocks, sum(user_id % 3)::BIGINT AS tx_items FROM b GROUP BY packet")
def structural_counts(spark, d):
    return checks.structural_counts(blocks(spark, d).withColumn("items", F.col("user_id") % 3), "items", "packet").select("packet", "blocks", "tx_blocks", "tx_items")


@query(_E + """ SELECT count(DISTINCT epoch)::BIGINT AS epochs, count(DISTINCT event_id)::BIGINT AS blocks, count(*)::BIGINT AS txs, (count(*) - count(DISTINCT (user_id, event_type)))::BIGINT AS duplicates,
count(*) FILTER (user_id % 2 = 0)::BIGINT AS native, count(*) FILTER (user_id % 2 = 1)::BIGINT AS espace, min(event_id) AS first_block, max(event_id) AS last_block FROM e""")
def replay_report(spark, d):
    e = epochs.assign_epochs(blocks(spark, d), "event_id", "pivot", "event_id")
    return checks.replay_report(e, "epoch", "event_id", ["user_id", "event_type"], F.col("user_id") % 2 == 1)


_NAMES = """WITH n AS (SELECT 'dir/epochs_' || (page_id // 2) * 2000 || '_' || ((page_id // 2) * 2000 + 1999) || CASE WHEN page_id % 2 = 1 THEN '.pack.zst' ELSE '.pack' END AS path, page_id // 2 * 2000 AS start, page_id % 2 = 1 AS compressed FROM pages)"""


@query(_NAMES + ' SELECT start, start + 1999 AS "end", path, compressed FROM n QUALIFY row_number() OVER (PARTITION BY start ORDER BY compressed DESC) = 1')
def file_prefer_compressed(spark, d):
    low = F.floor(F.col("page_id") / 2) * PACKET
    name = F.concat(F.lit("dir/epochs_"), low.cast("string"), F.lit("_"), (low + 1999).cast("string"), F.when(F.col("page_id") % 2 == 1, ".pack.zst").otherwise(".pack"))
    return packing.container_files(table(spark, d, "pages").select(name.alias("path"))).select("start", "end", "path", "compressed")


_Z = f"SELECT o_orderkey, ({_FLAGS} & ~64)::INTEGER AS old, CASE WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 0 ELSE round(c_acctbal * 100) END AS reward FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


def _patched(spark, d) -> DataFrame:
    b = flagged(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("flags", F.col("flags").bitwiseAND(~64))
    rewards = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") <= 0, 0).otherwise(cents("c_acctbal")).alias("total_reward"))
    return checks.patch_zero_reward(b, rewards, "o_custkey")


@query(f"SELECT o_orderkey, (CASE WHEN reward = 0 THEN old | 64 ELSE old END)::INTEGER AS flags, reward = 0 AS changed FROM ({_Z})")
def zero_reward_patch(spark, d):
    return _patched(spark, d).select("o_orderkey", "flags", "changed")


@query(f"SELECT count(*)::BIGINT AS scanned, count(*) FILTER (reward = 0)::BIGINT AS changed, count(*) FILTER (reward = 0)::BIGINT AS flagged, round(100 * count(*) FILTER (reward = 0) / count(*), 2)::DOUBLE AS percent FROM ({_Z})")
def patch_summary(spark, d):
    return checks.patch_summary(_patched(spark, d))


@query(_E + " SELECT e.event_id, coalesce(len(r.l), 0)::INTEGER AS n_rewards, r.l[1] AS first_reward FROM e LEFT JOIN (SELECT o_orderkey // 4 AS epoch, list(o_custkey ORDER BY o_custkey) AS l FROM orders GROUP BY 1) r ON r.epoch = e.epoch AND e.is_pivot")
def reward_inject(spark, d):
    b = epochs.assign_epochs(blocks(spark, d), "event_id", "pivot", "event_id").withColumn("rewards", F.expr("cast(array() as array<struct<event:bigint,execution_hash:bigint>>)"))
    events = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 4).alias("epoch"), F.col("o_custkey").alias("event"))
    out = checks.inject_rewards(b, events, "epoch", "pivot", "rewards", "event_id")
    return out.select("event_id", F.size("rewards").alias("n_rewards"), F.get("rewards", F.lit(0))["event"].alias("first_reward"))


@query("""WITH k AS (SELECT lpad(to_hex(c_custkey), 40, '0') AS a, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '81' END AS m, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '64617461' ELSE '636F6465' || lpad(to_hex(c_nationkey::BIGINT), 64, '0') END AS t, c_custkey FROM customer)
SELECT c_custkey, upper(a || m || t) AS key_hex FROM k""")
def canonical_keys(spark, d):
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "account").when(F.col("c_custkey") % 3 == 1, "storage_root").otherwise("code")
    suffix = F.when(kind == "code", F.unhex(F.lpad(F.hex("c_nationkey"), 64, "0")))
    space = F.when(F.col("c_custkey") % 2 == 0, "native").otherwise("ethereum")
    key = canonical_key(kind, F.unhex(F.lpad(F.hex("c_custkey"), 40, "0")), suffix, space)
    return c.select("c_custkey", F.hex(key).alias("key_hex"))


@query("SELECT hex(v) AS v_hex, user_id, n FROM (SELECT unhex(lpad(to_hex(user_id), 64, '0')) AS v, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL)")
def wide_integers(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.hex(codec.big_endian32(F.col("user_id"))).alias("v_hex"), "user_id", "n")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND length(h) > 0 THEN '0' || h[1] || h[2:] || CASE WHEN length(h) % 2 = 0 THEN '0' ELSE '' END ELSE h || CASE WHEN length(h) % 2 = 1 THEN '0' ELSE '' END END AS packed
FROM (SELECT p_partkey, upper(to_hex(p_partkey)) AS h FROM part)""")
def nibble_paths(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.hex(codec.packed_nibbles(F.hex("p_partkey"), F.col("p_partkey") % 2 == 1)).alias("packed"))


def _state_kv(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.unhex(F.lpad(F.hex("c_custkey"), 8, "0")).alias("key"), F.encode("c_name", "UTF-8").alias("value"))


@query()
def merkle_root_keccak(spark, d):
    return merkle.merkle_root(_state_kv(spark, d)).select(F.lower(F.hex("root")).alias("root"))


_NULLH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@query(f"""WITH v AS (SELECT r_regionkey AS d, sha256(unhex('6E' || repeat('{_NULLH}', 16) || '76' || hex(encode(r_name)))) AS core FROM region),
w AS (SELECT d, sha256(unhex('C1' || '00' || core)) AS h FROM v),
n AS (SELECT string_agg(coalesce(h, '{_NULLH}'), '' ORDER BY i) AS kids FROM range(16) t(i) LEFT JOIN w ON w.d = t.i)
SELECT sha256(unhex('6E' || kids)) AS root FROM n""")
def merkle_root_sha256(spark, d):
    r = table(spark, d, "region").select(F.unhex(F.concat(F.hex("r_regionkey"), F.lit("0"))).alias("key"), F.encode("r_name", "UTF-8").alias("value"))
    return merkle.merkle_root(r, hash_name="sha256").select(F.lower(F.hex("root")).alias("root"))


@query()
def merkle_incremental(spark, d):
    """Root after 1 % of the values changed, from the nodes of the map before."""
    kv = _state_kv(spark, d)
    index = merkle.Index.of(kv)
    changed = kv.where(F.pmod(F.crc32("key"), F.lit(100)) == 0)
    index.update(changed.withColumn("value", F.concat("value", F.lit(b"!"))))
    return spark.createDataFrame([(index.root.hex(),)], "root string")
