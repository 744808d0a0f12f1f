"""Validation reports and patch operators. A violation query returns the offending rows: none means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochweave.functions.codec import FLAG_ZERO_TOTAL_REWARD, FLAGS, has_flag


def packet_violations(blocks: DataFrame, packet: str = "packet", index: str = "index", flags: str = "flags", epoch: str = "epoch", height: str = "height") -> DataFrame:
    """(packet, index, problem): reserved flag bit set, index out of sequence, no pivot after the block, epoch not the pivot's height."""
    per = blocks.groupBy(packet).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("distinct"), F.min(index).alias("low"), F.max(index).alias("high"))
    broken = per.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("distinct") != F.col("n"))).select(packet, F.lit(None).cast("long").alias(index), F.lit("index").alias("problem"))
    one = F.array_compact(
        F.array(
            F.when(F.col(flags).bitwiseAND(128) != 0, F.lit("reserved flag")),
            F.when(F.col(epoch).isNull(), F.lit("no pivot")),
            F.when(has_flag(F.col(flags), "pivot") & (F.col(epoch) != F.col(height)), F.lit("epoch")),
        )
    )
    rows = blocks.select(packet, F.col(index).cast("long").alias(index), F.explode(one).alias("problem"))
    return rows.unionByName(broken)


def structural_counts(blocks: DataFrame, items: str, packet: str) -> DataFrame:
    """(packet, blocks, tx_blocks, tx_items); ``items`` is the number of payload items of a block."""
    return blocks.groupBy(packet).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col(items) > 0).alias("tx_blocks"), F.sum(items).cast("long").alias("tx_items"))


def replay_counts(blocks: DataFrame, packet: str = "start_epoch") -> DataFrame:
    """(packet, epochs, blocks, txs, duplicates, native, espace) of block rows, blocks without transactions included.

    A transaction that refers to an earlier one of its packet is a duplicate.
    """
    space = lambda name: F.coalesce(F.size(F.filter("transactions", lambda t: t["space"] == name)), F.lit(0))
    again = F.coalesce(F.size(F.filter("transaction_refs", lambda r: r.isNotNull())), F.lit(0))
    counted = blocks.select(packet, "epoch", F.when(F.col("transactions").isNull(), 0).otherwise(F.size("transactions")).alias("n"), F.greatest(again, F.lit(0)).alias("again"), F.greatest(space("native"), F.lit(0)).alias("native"), F.greatest(space("ethereum"), F.lit(0)).alias("espace"))
    sums = [F.sum(c).cast("long").alias(a) for c, a in (("n", "txs"), ("again", "duplicates"), ("native", "native"), ("espace", "espace"))]
    return counted.groupBy(packet).agg(F.countDistinct("epoch").alias("epochs"), F.count(F.lit(1)).alias("blocks"), *sums)


def replay_problems(blocks: DataFrame, packet: str = "start_epoch") -> DataFrame:
    """(packet, index, problem): ``packet_violations`` with blocks that hold transactions without the flag for it."""
    bare = blocks.where((F.size("transactions") > 0) & ~has_flag(F.col("flags"), "has_transactions"))
    return packet_violations(blocks, packet).unionByName(bare.select(packet, F.col("index").cast("long").alias("index"), F.lit("transaction flag").alias("problem")))


def replay_report(txs: DataFrame, epoch: str, block: str, identity: list[str], espace: Column) -> DataFrame:
    """One row: epochs, blocks, txs, duplicates, native and espace counts, block range."""
    return txs.agg(
        F.countDistinct(epoch).alias("epochs"),
        F.countDistinct(block).alias("blocks"),
        F.count(F.lit(1)).alias("txs"),
        (F.count(F.lit(1)) - F.countDistinct(*identity)).alias("duplicates"),
        F.count_if(~espace).alias("native"),
        F.count_if(espace).alias("espace"),
        F.min(block).alias("first_block"),
        F.max(block).alias("last_block"),
    )


def pack_summary(groups: DataFrame, container: str, epochs: str, blocks: str, size: str) -> DataFrame:
    """One row: files, groups, epochs, blocks, bytes, mean bytes of a file."""
    per = groups.groupBy(container).agg(F.count(F.lit(1)).alias("g"), F.sum(epochs).alias("e"), F.sum(blocks).alias("b"), F.sum(size).alias("s"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("g").alias("groups"), F.sum("e").alias("epochs"), F.sum("b").alias("blocks"), F.sum("s").alias("bytes"), F.floor(F.avg("s")).alias("mean_bytes"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``; none means that both hold the same rows."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def flag_sites(blocks: DataFrame, flags: str = "flags", key: str = "hash") -> DataFrame:
    """Only flags and keys of blocks: a scan of these two columns."""
    return blocks.select(key, flags)


def patch_zero_reward(blocks: DataFrame, rewards: DataFrame, key: str, flags: str = "flags", height: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """``blocks`` with bit 6 set where the total reward is zero or missing, within [low, high) of ``height``; and ``changed``. Idempotent."""
    joined = blocks.join(rewards.select(F.col(key), F.col("total_reward").alias("__reward")), key, "left")
    inside = F.lit(True)
    if height is not None:
        inside = F.lit(True) if low is None else F.col(height) >= low
        inside = inside if high is None else inside & (F.col(height) < high)
    zero = inside & (F.coalesce("__reward", F.lit(0)) == 0)
    new = F.when(zero, F.col(flags).bitwiseOR(FLAG_ZERO_TOTAL_REWARD)).otherwise(F.col(flags))
    return joined.withColumn("changed", new != F.col(flags)).withColumn(flags, new).drop("__reward")


def patch_summary(patched: DataFrame, flags: str = "flags") -> DataFrame:
    """One row: scanned, changed, flagged, percent (two digits)."""
    flagged = F.count_if(F.col(flags).bitwiseAND(FLAGS["zero_total_reward"]) != 0)
    return patched.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("changed").alias("changed"), flagged.alias("flagged"), F.round(100 * flagged / F.count(F.lit(1)), 2).alias("percent"))


def inject_rewards(blocks: DataFrame, events: DataFrame, epoch: str, pivot: str, rewards: str, hash_column: str) -> DataFrame:
    """``blocks`` whose pivots get the events of their epoch appended, each under the pivot's own hash. Not idempotent.

    ``events`` is (epoch, event), several per epoch allowed; they are gathered per epoch.
    """
    mine = events.groupBy(epoch).agg(F.sort_array(F.collect_list("event")).alias("__events"))
    own = F.transform("__events", lambda e: F.struct(e.alias("event"), F.col(hash_column).alias("execution_hash")))
    joined = blocks.join(mine, epoch, "left")
    more = F.when(F.col(pivot) & F.col("__events").isNotNull(), F.concat(F.col(rewards), own)).otherwise(F.col(rewards))
    return joined.withColumn(rewards, more).drop("__events")


def reward_blocks(blocks: DataFrame, rewards: str, key: str, wanted: list | None = None) -> DataFrame:
    """Blocks with any reward event, or with one of the wanted keys."""
    test = F.size(rewards) > 0
    return blocks.where(test | F.col(key).isin(wanted) if wanted else test)
