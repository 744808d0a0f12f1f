"""Dictionaries of frequent values, encodings against them, and duplicate references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochweave.functions.codec import uleb_length
from epochweave.session import materialize


def frequency_table(df: DataFrame, value: str, order: str, packet: str | None = None, more_than: int = 0, most: int | None = None) -> DataFrame:
    """(packet, value, n, first_seen, index): values by count, then by first sight; index from 0.

    Only the distinct values of a packet are ranked. ``more_than`` drops values
    that are not seen more often; ``most`` keeps the first ones. Without a
    packet and with ``most``, a top-k replaces the ranking of all values; else
    these are dealt out by ranges of rank, and each range counts on from those
    before it.
    """
    by = [packet] if packet else []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    if more_than:
        counted = counted.where(F.col("n") > more_than)
    rank = (F.desc("n"), F.asc("first_seen"))
    if not packet and not most:
        return _ranked(counted, rank)
    if not packet:
        counted = counted.orderBy(*rank).limit(most)
    ranked = counted.withColumn("index", (F.row_number().over((W.partitionBy(packet) if packet else W.partitionBy()).orderBy(*rank)) - 1).cast("long"))
    return ranked.where(F.col("index") < most) if most and packet else ranked


def _ranked(counted: DataFrame, rank: tuple) -> DataFrame:
    """``counted`` with index: the place of each row in the order ``rank``, without a window over all rows."""
    dealt = materialize(counted.repartitionByRange(*rank).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*rank)) - 1
    return dealt.join(before, "__part").withColumn("index", (F.col("__before") + place).cast("long")).drop("__part", "__before")


def combined(df: DataFrame, columns: list[str], order: str, keep: list[str] = ()) -> DataFrame:
    """(*keep, value, order): several columns as one, in their order within a row."""
    parts = [df.select(*keep, F.col(c).alias("value"), (F.col(order) * len(columns) + i).alias(order)) for i, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, parts)


def first_seen(df: DataFrame, value: str, order: str, packet: str) -> DataFrame:
    """(packet, value, first_seen, index): distinct values in the order of first sight."""
    found = df.where(F.col(value).isNotNull()).groupBy(packet, value).agg(F.min(order).alias("first_seen"))
    return found.withColumn("index", (F.row_number().over(W.partitionBy(packet).orderBy("first_seen")) - 1).cast("long"))


def sender_base_nonces(txs: DataFrame, packet: str, sender: str, nonce: str, least_saving: int = 16) -> DataFrame:
    """(packet, sender, base_nonce, saving): senders for whom offsets from the least nonce save that many bytes."""
    least = txs.groupBy(packet, sender).agg(F.min(nonce).alias("base_nonce"))
    saved = uleb_length(F.col(nonce)) - uleb_length(F.col(nonce) - F.col("base_nonce"))
    joined = txs.join(least, [packet, sender])
    return joined.groupBy(packet, sender, "base_nonce").agg(F.sum(saved).cast("long").alias("saving")).where(F.col("saving") >= least_saving)


def nonce_offsets(txs: DataFrame, bases: DataFrame, packet: str, sender: str, nonce: str) -> DataFrame:
    """``txs`` with nonce_offset; senders without a base start from 0."""
    return txs.join(bases.select(packet, sender, "base_nonce"), [packet, sender], "left").withColumn("nonce_offset", F.greatest(F.lit(0), F.col(nonce) - F.coalesce("base_nonce", F.lit(0)))).drop("base_nonce")


def encode(df: DataFrame, dictionary: DataFrame, value: str, index: str = "index", keys: list[str] = ()) -> DataFrame:
    """``df`` with the dictionary index of ``value``; a missing value is an error."""
    joined = df.join(dictionary.select(*keys, F.col(value).alias("__value"), F.col(index).alias("__index")), [*(df[k] == dictionary[k] for k in keys), df[value] == F.col("__value")] if keys else df[value] == F.col("__value"), "left")
    code = F.when(F.col("__index").isNull(), F.raise_error(F.lit(f"{value} is not in its dictionary")).cast("long")).otherwise(F.col("__index"))
    return joined.withColumn(f"{value}_index", code).drop("__value", "__index")


def decode(df: DataFrame, dictionary: DataFrame, value: str, index: str = "index") -> DataFrame:
    """Inverse of ``encode``; an index out of bounds is an error."""
    joined = df.join(dictionary.select(F.col(value).alias("__value"), F.col(index).alias(f"{value}_index")), f"{value}_index", "left")
    return joined.withColumn(value, F.when(F.col("__value").isNull(), F.raise_error(F.lit("an index is out of bounds")).cast("string")).otherwise(F.col("__value"))).drop("__value", f"{value}_index")


def duplicate_references(items: DataFrame, identity: list[str], order: str, packet: str) -> DataFrame:
    """``items`` with ref: the order of the first equal item of the packet, NULL on that one itself.

    The first ones are found by a partial aggregate and joined back, so a hot
    identity is never gathered in a window.
    """
    firsts = items.groupBy(packet, *identity).agg(F.min(order).alias("__first"))
    joined = items.join(firsts, [packet, *identity])
    return joined.withColumn("ref", F.when(F.col("__first") != F.col(order), F.col("__first"))).drop("__first")


def resolve_references(items: DataFrame, order: str, packet: str, payload: list[str], ref: str = "ref") -> DataFrame:
    """``items`` whose references take the payload of the item they point to; only earlier items count."""
    source = items.where(F.col(ref).isNull()).select(F.col(packet).alias("__p"), F.col(order).alias("__o"), *(F.col(c).alias(f"__{c}") for c in payload))
    joined = items.join(source, (F.col(packet) == F.col("__p")) & (F.col(ref) == F.col("__o")) & (F.col("__o") < F.col(order)), "left")
    return joined.withColumns({c: F.when(F.col(ref).isNull(), F.col(c)).otherwise(F.col(f"__{c}")) for c in payload}).drop("__p", "__o", *(f"__{c}" for c in payload))
