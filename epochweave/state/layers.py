"""Layered key-value state: snapshot, intermediate, delta.

A layer row is (layer, key, value, is_tombstone); layer 0 is delta, 1
intermediate, 2 snapshot. Absent, tombstone and live stay three states. Reads
take the first layer that knows a key; a tombstone there means not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA, INTERMEDIATE, SNAPSHOT = 0, 1, 2


def latest(ops: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: its last operation."""
    rest = [c for c in ops.columns if c != key]
    return ops.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("o")).select(key, "o.*")


def in_prefix(key: Column, prefix: str | bytes) -> Column:
    """``key`` starts with ``prefix``, as a range that reaches the scan."""
    if isinstance(prefix, bytes):
        end = prefix.rstrip(b"\xff")
        return key >= F.lit(prefix) if not end else (key >= F.lit(prefix)) & (key < F.lit(end[:-1] + bytes([end[-1] + 1])))
    return key >= F.lit(prefix) if not prefix else (key >= F.lit(prefix)) & (key < F.lit(prefix[:-1] + chr(ord(prefix[-1]) + 1)))


def visible(layers: DataFrame, key: str = "key") -> DataFrame:
    """(key, value, layer): what reads see."""
    top = layers.groupBy(key).agg(F.min_by(F.struct("value", "is_tombstone", "layer"), "layer").alias("t"))
    return top.where(~F.col("t.is_tombstone")).select(key, "t.value", "t.layer")


def get(layers: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, value): batched point reads; keys that are not found are not there."""
    return visible(layers.join(keys.select(key).distinct(), key, "left_semi"), key).select(key, "value")


def get_prefix(layers: DataFrame, prefix: str | bytes, key: str = "key") -> DataFrame:
    """(key, value) of all live keys under a prefix."""
    return visible(layers.where(in_prefix(F.col(key), prefix)), key).select(key, "value")


def put(layers: DataFrame, ops: DataFrame, order: str, key: str = "key") -> DataFrame:
    """``layers`` with the last of ``ops`` (key, value, order) per key in delta; an empty or null value is a tombstone."""
    last = latest(ops.select(key, "value", order), key, order)
    size = F.length(F.col("value").cast("string"))
    fresh = last.select(F.lit(DELTA).alias("layer"), key, "value", (F.col("value").isNull() | (size == 0)).alias("is_tombstone"))
    stale = layers.where(F.col("layer") == DELTA).join(fresh.select(key), key, "left_anti")
    return layers.where(F.col("layer") != DELTA).unionByName(stale).unionByName(fresh)


def delete_prefix(layers: DataFrame, prefix: str | bytes, whole_delta: bool = False, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(layers after, removed): delta rows under the prefix go, what is visible below gets tombstones there.

    ``whole_delta`` empties the delta, matching or not, as deletes by address
    prefix do: values of lower layers may come to light again. ``removed`` are
    the (key, value) that reads saw under the prefix before.
    """
    hit = in_prefix(F.col(key), prefix)
    removed = visible(layers.where(hit), key).select(key, "value")
    below = visible(layers.where(hit & (F.col("layer") != DELTA)), key).select(key)
    stones = below.select(F.lit(DELTA).alias("layer"), key, F.lit(None).cast(layers.schema["value"].dataType).alias("value"), F.lit(True).alias("is_tombstone"))
    rest = layers.where(F.col("layer") != DELTA) if whole_delta else layers.where((F.col("layer") != DELTA) | ~hit)
    return rest.unionByName(stones), removed


def merge(layers: DataFrame, key: str = "key") -> DataFrame:
    """(key, value) of the next snapshot: the snapshot with intermediate writes put in and tombstones taken out."""
    return visible(layers.where(F.col("layer") != DELTA), key).select(key, "value")


def rotate(layers: DataFrame, key: str = "key") -> DataFrame:
    """``layers`` one period on: intermediate merged into the snapshot, delta become intermediate, an empty delta."""
    snapshot = merge(layers, key).select(F.lit(SNAPSHOT).alias("layer"), key, "value", F.lit(False).alias("is_tombstone"))
    moved = layers.where(F.col("layer") == DELTA).withColumn("layer", F.lit(INTERMEDIATE))
    return snapshot.unionByName(moved)


def is_boundary(height: int, period: int) -> bool:
    return height > 0 and height % period == 0
