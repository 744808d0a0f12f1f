"""Connected components by alternating stars, as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.session import discard, materialize

EDGE = "a bigint, b bigint"


class Forest:
    """Union-find over any hashable items; the smaller root stays."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.up[y] = x
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def stars(pairs: Iterable[tuple[int, int]]) -> pa.Table:
    """(a, b): a forest with the components of ``pairs``, as stars: never more edges, mostly far fewer."""
    forest = Forest()
    for a, b in pairs:
        forest.join(a, b)
    found = [(x, forest.find(x)) for x in list(forest.up)]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    ``edges`` has long columns a and b. Each round links what lies above a node
    to the least of its neighbourhood, then does the same for what lies below;
    only minima and joins are used, so a hub of any size is never gathered.
    Rounds end when the stars no longer change; each is written to the shared
    folder. Nulls and loops are dropped.
    """
    least = F.least("u", F.min("v")).alias("m")
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(now.distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(both.groupBy("u").agg(least), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        lows = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lows, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lows.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last, now = now, materialize(small.distinct(), "edges")
        discard(last)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


#: Parts in which the nodes of a component look up their least id.
SALTS = 32


def least_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, component_id) of ``nodes`` (node, least): the least of all ``least`` of a node's component in ``roots`` (node, root); a node without links is its own root.

    By component: partial minima, and salted keys where its nodes look theirs up.
    """
    linked = nodes.join(roots, "node").withColumn("salt", F.pmod("node", F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", salts)
    named = linked.join(lowest, ["root", "salt"]).select("node", "root", "component_id")
    return nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id"))


def sorted_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common items of two sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
