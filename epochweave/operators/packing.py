"""Sizes and places: prefix choice, container packing, payload offsets, file preference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def choose_prefix(records: DataFrame, length: Column, by: list[str] = ()) -> DataFrame:
    """(*by, prefix_size): the least of 64, 72, 80, 88, 96 that holds 90 % (from 80 on, 70 %) of the records; 96 at most."""
    fits = {n: F.avg(F.when(length <= n, 1.0).otherwise(0.0)) for n in (64, 72, 80, 88)}
    choice = F.when(fits[64] >= 0.9, 64).when(fits[72] >= 0.9, 72).when(fits[80] >= 0.7, 80).when(fits[88] >= 0.7, 88).otherwise(96)
    return records.groupBy(*by).agg(choice.cast("long").alias("prefix_size"))


def pack_containers(groups: DataFrame, job: str, order: str, size: str, target: int) -> DataFrame:
    """``groups`` with container (number within the job) and offset (payload bytes before it there).

    A container is closed by the group that reaches the target. Jobs pack
    their own ranges apart, so each is one ordered pass over its own groups.
    """
    schema = groups.select("*").schema.add("container", "long").add("offset", "long")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        number, filled, numbers, offsets = 0, 0, [], []
        for n in pdf[size].tolist():
            numbers.append(number)
            offsets.append(filled)
            filled += n
            if filled >= target:
                number, filled = number + 1, 0
        return pdf.assign(container=numbers, offset=offsets)

    return groups.groupBy(job).applyInPandas(fold, schema)


def running_offsets(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """``df`` with offset: the sizes before each row of its group."""
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def container_files(names: DataFrame, path: str = "path", suffix: str = r"\.pack(\.zst)?") -> DataFrame:
    """(start, end, path, compressed): one file per start epoch, compressed ones first; names end in _<start>_<end>."""
    parsed = names.withColumn("start", F.regexp_extract(path, rf"_(\d+)_(\d+){suffix}$", 1)).withColumn("end", F.regexp_extract(path, rf"_(\d+)_(\d+){suffix}$", 2))
    found = parsed.where("start <> ''").select(F.col("start").cast("long"), F.col("end").cast("long"), F.col(path).alias("path"), F.col(path).endswith(".zst").alias("compressed"))
    return found.groupBy("start").agg(F.max_by(F.struct("end", "path", "compressed"), F.struct("compressed", "path")).alias("f")).select("start", "f.*")
