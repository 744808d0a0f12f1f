"""Landed key-value records and small files: point and full reads, unlock events, reward lists, single-packet shards."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.functions.codec import little_endian
from epochweave.sources import packets
from epochweave.sources.containers import SHARD_SUFFIX

REWARD_FIELDS = "address string, pos_identifier string, reward string"


def point_get(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows of the wanted keys: many point reads are one semi-join."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def required_sets(epochs: DataFrame, executed: DataFrame, skipped: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``epochs`` with its executed (missing: an error) and skipped (missing: empty) hashes."""
    joined = epochs.join(executed, epoch, "left").join(skipped, epoch, "left")
    whole = F.when(F.col("executed").isNull(), F.raise_error(F.lit("an executed set is missing")).cast("array<binary>")).otherwise(F.col("executed"))
    return joined.withColumn("executed", whole).withColumn("skipped", F.coalesce("skipped", F.expr("cast(array() as array<binary>)")))


def latest_rewards(records: DataFrame, pivots: DataFrame) -> DataFrame:
    """Reward records of the pivots' hashes, the last PoS epoch of each; records of other hashes go before any shuffle of theirs."""
    mine = records.join(pivots.select(F.col("hash").alias("execution_hash")), "execution_hash", "left_semi")
    rest = [c for c in mine.columns if c != "execution_hash"]
    return mine.groupBy("execution_hash").agg(F.max_by(F.struct(*rest), "pos_epoch").alias("r")).select("execution_hash", "r.*")


def unlock_events(events: DataFrame, event_key: bytes, low: int, high: int) -> DataFrame:
    """(version, identifier, unlocked) of raw events (version, key, data) with low <= version < high.

    Events of other keys are dropped; data is a 32-byte identifier and a little-endian 8-byte count.
    """
    chosen = events.where((F.col("version") >= low) & (F.col("version") < high) & (F.col("key") == F.lit(event_key)) & (F.length("data") == 40))
    return chosen.select("version", F.substring("data", 1, 32).alias("identifier"), little_endian(F.substring("data", 33, 8)).alias("unlocked"))


def read_reward_lists(spark: SparkSession, path: str) -> DataFrame:
    """(execution_epoch_hash, account_rewards) of JSON files, one object a file with any layout of lines.

    account_rewards is an array of (address, pos_identifier, reward): hex
    strings with or without 0x become bytes, decimal rewards of up to 38 digits
    32 bytes; a longer or malformed number is an error.
    """
    raw = spark.read.text(path, wholetext=True)
    bare = lambda c: F.unhex(F.regexp_replace(c, "^0x", ""))
    found = F.regexp_extract_all("value", F.lit(r'\{[^{}]*"address"[^{}]*\}'), F.lit(0))
    account = lambda x: F.struct(bare(x["address"]).alias("address"), bare(x["pos_identifier"]).alias("pos_identifier"), decimal_bytes(x["reward"]).alias("reward"))
    rewards = F.transform(F.transform(found, lambda x: F.from_json(x, REWARD_FIELDS)), account)
    return raw.select(bare(F.regexp_extract("value", r'"execution_epoch_hash"\s*:\s*"([^"]*)"', 1)).alias("execution_epoch_hash"), rewards.alias("account_rewards"))


def decimal_bytes(digits: Column) -> Column:
    """A string of decimal digits below 2**256 as 32 bytes, big-endian; anything else but null is an error.

    Digits are taken 9 at a time into words of 32 bits, least first: every word
    is multiplied by 10**9 and passes what is over to the next.
    """
    padded = F.lpad(digits, 81, "0")
    parts = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.substring(padded, i * 9 + 1, F.lit(9)).cast("long"))
    word, over = F.lit(1 << 32), F.lit(10**9)
    zero = F.expr("cast(array_repeat(0L, 8) as array<bigint>)")

    def more(words: Column, part: Column) -> Column:
        """``words`` times 10**9 plus ``part``."""
        step = lambda done, w: F.struct(F.array_append(done["words"], F.pmod(w * over + done["carry"], word)).alias("words"), F.call_function("div", w * over + done["carry"], word).alias("carry"))
        start = F.struct(F.expr("cast(array() as array<bigint>)").alias("words"), part.alias("carry"))
        too_large = F.raise_error(F.lit("a number of more than 256 bits")).cast("array<bigint>")
        return F.aggregate(words, start, step, lambda d: F.when(d["carry"] > 0, too_large).otherwise(d["words"]))

    words = F.aggregate(parts, zero, more)
    raw = F.unhex(F.array_join(F.transform(F.reverse(words), lambda w: F.lpad(F.hex(w), 8, "0")), ""))
    wrong = F.raise_error(F.concat(F.lit("not a decimal number: "), digits)).cast("binary")
    return F.when(digits.isNull(), F.lit(None).cast("binary")).when(~digits.rlike("^0*[0-9]{1,78}$"), wrong).otherwise(raw)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(start_epoch, end_epoch, packet) of the single-packet files ``<start>-<end>`` of a folder, by start."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SHARD_SUFFIX}").load(path)
    stem = rf"(\d+)-(\d+)\{SHARD_SUFFIX}$"
    return files.select(F.regexp_extract("path", stem, 1).cast("long").alias("start_epoch"), F.regexp_extract("path", stem, 2).cast("long").alias("end_epoch"), F.col("content").alias("packet")).where("start_epoch is not null")


def shard_files(groups: DataFrame) -> DataFrame:
    """(name, content) of (start_epoch, epochs, packet) rows, for the container writer."""
    name = F.concat(F.col("start_epoch").cast("string"), F.lit("-"), (F.col("start_epoch") + F.col("epochs") - 1).cast("string"), F.lit(SHARD_SUFFIX))
    return groups.select(name.alias("name"), F.col("packet").alias("content"))


def roundtrip(groups: DataFrame, pos_from: int) -> DataFrame:
    """(start_epoch, equal, first_difference) of decoding and encoding (start_epoch, packet) rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for start, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py()
                head, blocks = packets.decode(data, pos_from)
                again = packets.encode(blocks, head["prev_last_hash"], head["prev_last_deferred_state_root"], head["first_block_number"], head["pos_entries"], head)
                at = next((i for i, (a, b) in enumerate(zip(data, again, strict=False)) if a != b), None)
                if at is None and len(data) != len(again):
                    at = min(len(data), len(again))
                rows.append((start, at is None, at))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64())], ["start_epoch", "equal", "first_difference"])

    return groups.select("start_epoch", "packet").mapInArrow(run, "start_epoch bigint, equal boolean, first_difference bigint")
