"""The extraction dataflow: landed tables of a chain to block rows, ready for packets.

``tables`` maps names to DataFrames: epochs (epoch, pivot_hash, executed,
skipped), headers (hash, height, adaptive, author, timestamp, difficulty,
gas_limit, base_price_core, base_price_espace, blame, deferred roots, pos_ref),
bodies (hash, transactions), rewards (hash, total_reward, base_reward),
committed (pos_ref, pivot_decision, view, version), pos_rewards (execution_hash,
pos_epoch, account_rewards), unlocks (version, identifier, unlocked), contexts
(hash, start_block_number).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.functions.codec import block_flags
from epochweave.operators import epochs
from epochweave.session import materialize
from epochweave.sources.containers import EPOCHS


@dataclass(frozen=True)
class Chain:
    """Parameters of a chain; the defaults never reach the PoS height."""

    evm_transaction_block_ratio: int = 5
    pos_reference_enable_height: int = (1 << 63) - 1
    cip112_transition_height: int = (1 << 63) - 1

    @classmethod
    def from_toml(cls, path: str) -> Chain:
        import tomllib

        with open(path, "rb") as f:
            found = tomllib.load(f)
        return cls(**{k: v for k, v in found.items() if k in cls.__dataclass_fields__})


def required(column: str, what: str):
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"{what} is missing")))


def extract_blocks(tables: dict[str, DataFrame], chain: Chain, low: int, high: int, group: int = EPOCHS) -> DataFrame:
    """Block rows of the epochs [low, high), with group number ``packet`` and place ``index`` in it.

    Missing headers are an error, missing bodies are empty, missing rewards are zero.
    """
    chosen = grouped_epochs(tables, low, high, group).withColumn("pivot_hash", required("pivot_hash", "a pivot")).withColumn("executed", required("executed", "an executed set"))
    headers = _referenced(tables, chain)
    order = epochs.placed_blocks(chosen).withColumn("is_pivot", F.col("class") == 2)
    b = order.join(headers.withColumn("__known", F.lit(True)), "hash", "left")
    b = b.join(tables["bodies"], "hash", "left").join(tables["rewards"], "hash", "left")
    pivots = chosen.select("packet", "epoch", F.col("pivot_hash").alias("hash")).join(headers.select("hash", "version"), "hash", "left")
    pivots = materialize(pivots, "pivots")
    b = b.join(_pos_rewards(pivots, tables["pos_rewards"]), "hash", "left").join(_unlocks(pivots, tables["unlocks"]), "hash", "left")
    lost = lambda test, kind, what, c: F.when(test, F.raise_error(F.lit(what)).cast(kind)).otherwise(F.col(c))
    b = b.withColumn("height", lost(F.col("__known").isNull(), "long", "a header is missing", "height"))
    b = b.withColumn("pos_ref", lost(F.col("pos_ref").isNotNull() & F.col("committed").isNull(), "binary", "a committed block is missing", "pos_ref"))
    return b.select(
        *("packet", "index", "epoch", "hash", "height", "author", "timestamp", "difficulty", "gas_limit", "base_price_core", "base_price_espace", "blame"),
        *("deferred_state_root", "deferred_receipts_root", "deferred_logs_bloom_hash", "pos_ref", "pos_view", "transactions", "total_reward", "pos_rewards"),
        F.coalesce("base_reward", F.lit(0)).cast("decimal(26,0)").alias("base_reward"),
        block_flags(F.col("adaptive"), F.col("is_pivot"), F.col("height"), chain.evm_transaction_block_ratio, F.col("class") == 1, F.col("total_reward")).alias("flags"),
        epochs.offset_since(F.col("epoch"), F.col("pos_ref"), F.col("decided_height")).alias("finalized_epoch"),
        F.when(F.col("is_pivot"), F.col("unlock_events")).alias("unlock_events"),
    )


def grouped_epochs(tables: dict[str, DataFrame], low: int, high: int, group: int = EPOCHS) -> DataFrame:
    """The epochs [low, high) with the number of their group."""
    return tables["epochs"].where((F.col("epoch") >= low) & (F.col("epoch") < high)).withColumn("packet", F.floor((F.col("epoch") - low) / group))


def _referenced(tables: dict[str, DataFrame], chain: Chain) -> DataFrame:
    """Headers with their effective reference and what it leads to: whether it is committed, the height of the pivot that it decided, view and version.

    References are few, one to many blocks: resolved first, they are a small table that the headers meet once.
    """
    committed = tables["committed"].select("pos_ref", "pivot_decision", F.col("view").alias("pos_view"), "version", F.lit(True).alias("committed"))
    resolved = materialize(epochs.decided_heights(committed, tables["headers"]).drop("pivot_decision"), "references")
    headers = tables["headers"].withColumn("pos_ref", epochs.effective_reference(F.col("height"), F.col("pos_ref"), chain.pos_reference_enable_height))
    return headers.join(resolved, "pos_ref", "left")


def packet_heads(blocks: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(packet, prev_last_hash, prev_last_deferred_state_root, first_block_number): what stands before each group of blocks, or of epochs.

    The pivot of the epoch before (of epoch 0 for the first) and its header,
    and the start number in the context of the group's first pivot, from
    ``tables["contexts"]`` (hash, start_block_number). Anything missing is an error.
    """
    first = blocks.groupBy("packet").agg(F.min("epoch").alias("first_epoch")).withColumn("previous_epoch", F.greatest(F.col("first_epoch") - 1, F.lit(0)))
    pivots = tables["epochs"].select("epoch", "pivot_hash")
    heads = first.join(pivots.select(F.col("epoch").alias("previous_epoch"), F.col("pivot_hash").alias("prev_last_hash")), "previous_epoch", "left")
    heads = heads.join(tables["headers"].select(F.col("hash").alias("prev_last_hash"), F.col("deferred_state_root").alias("prev_last_deferred_state_root")), "prev_last_hash", "left")
    heads = heads.join(pivots.select(F.col("epoch").alias("first_epoch"), F.col("pivot_hash").alias("first_pivot")), "first_epoch", "left")
    heads = heads.join(tables["contexts"].select(F.col("hash").alias("first_pivot"), F.col("start_block_number").alias("first_block_number")), "first_pivot", "left")
    whole = lambda c, kind, what: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{what} is missing")).cast(kind)).otherwise(F.col(c)).alias(c)
    return heads.select("packet", whole("prev_last_hash", "binary", "the previous pivot"), whole("prev_last_deferred_state_root", "binary", "the previous pivot's header"), whole("first_block_number", "long", "the first pivot's epoch context"))


def _pos_rewards(pivots: DataFrame, rewards: DataFrame) -> DataFrame:
    """(hash, pos_rewards): reward events of executed pivots; of several for one hash the last PoS epoch wins."""
    events = rewards.select(F.col("execution_hash").alias("hash"), "pos_epoch", "account_rewards")
    found = epochs.attach_rewards(pivots.select("hash"), events, "hash", "pos_epoch").where("account_rewards is not null")
    return found.select("hash", F.array(F.struct(F.col("account_rewards"), F.col("hash").alias("execution_epoch_hash"))).alias("pos_rewards"))


def _unlocks(pivots: DataFrame, unlocks: DataFrame, width: int = 64) -> DataFrame:
    """(hash, unlock_events): unlocks between the PoS versions of consecutive pivots, for the later one."""
    carried = epochs.last_of_previous(pivots, "version", "epoch", "packet")
    spans = epochs.previous_values(pivots, "version", "epoch", "packet", carried).where("version is not null and previous_version < version")
    joined = epochs.range_join(spans, unlocks.withColumnRenamed("version", "unlock_version"), "previous_version", "version", "unlock_version", width)
    listed = F.sort_array(F.collect_list(F.struct("unlock_version", "identifier", "unlocked")))
    return joined.groupBy("hash").agg(F.transform(listed, lambda x: F.struct(x["identifier"].alias("identifier"), x["unlocked"].alias("unlocked"))).alias("unlock_events"))
