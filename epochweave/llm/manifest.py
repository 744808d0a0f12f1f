"""Merkle manifest of a dataset: bottom-up build, top-down proof push.

Each row is a leaf, the hash of its fields; the leaves of a group (a source)
ascend by an order column, and every ``RUN`` neighbours become their hash,
level by level, until one node remains, the group's subroot. Subroots in the
order of their groups make the root in the same way. Levels are tables of
their own: a node's row has its children, so a proof is pushed down by joins
of a level with the proofs of the level above. Each child puts its siblings
before the proof that it inherits. Keys of these joins are places in the
trees, which no two nodes share, so no group is too large for a task; leaves
get their places by ranges of the order, each counting on from those before.

Nulls: a null field is ``-``; the null group comes first, rows without an id
come first in their group. Repeated rows, or rows that share an id, are leaves
of their own, in the order of their hashes. Empty texts have length 0. Very
long texts are hashed where they are read and not sent anywhere. Empty tables
give empty results. Only the fields, the group and the order are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochweave.session import discard, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3


def field(value: Column) -> Column:
    """A field as it is hashed: its byte length, a colon and its value, or ``-`` for null; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The hash of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _joined(digests: Column) -> Column:
    """The hash of some digests as hex text, one after the other."""
    return F.unhex(F.sha2(F.concat_ws("", F.transform(digests, lambda d: F.lower(F.hex(d)))), 256))


def _offsets(dealt: DataFrame, by: list[str]) -> DataFrame:
    """(*by, part, low, before, n): of each group in each partition of ``dealt``, its first running number, the group's rows before it, and the group's rows."""
    sizes = dealt.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"))
    order = W.partitionBy(*by).orderBy("part")  # a row per partition and group, not per leaf
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*by, "part", "low", before.alias("before"), F.sum("rows").over(W.partitionBy(*by)).alias("n"))


def _dealt(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows``, written in ranges of ``order``, with the number of their range and a running number."""
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in [*order, "tie"]]
    ranges = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    return materialize(ranges.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (group, order, digest, ...) with g, the group's place, pos, the leaf's place in it, n, the leaves of it, and groups, their number."""
    dealt = _dealt(leaves, ["group", "order", "digest"], "leaves")
    parts = _offsets(dealt, ["group"])
    groups = _dealt(parts.select("group").distinct(), ["group"], "groups")
    ranks = groups.join(_offsets(groups, []).select("part", "low", "before", F.col("n").alias("groups")), "part").select(F.col("group").alias("name"), (F.col("before") + F.col("at") - F.col("low")).alias("g"), "groups")
    known = parts.join(ranks, parts["group"].eqNullSafe(ranks["name"])).select("name", F.col("part").alias("in_part"), "low", "before", "n", "g", "groups")
    both = dealt.join(known, dealt["group"].eqNullSafe(known["name"]) & (dealt["part"] == known["in_part"]))
    return both.withColumn("pos", F.col("before") + F.col("at") - F.col("low")).drop("name", "in_part", "low", "before", "part", "at", "group")


def _levels(nodes: DataFrame, keep: list[str], run: int) -> list[DataFrame]:
    """The levels above ``nodes`` (g, pos, n, digest), each written: g, pos, n, digest, kids; ``keep``: what the lowest kids carry."""
    most, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        kid = F.struct("pos", "digest", *(keep if not out else []))
        runs = nodes.where("n > 1").groupBy("g", F.floor(F.col("pos") / run).alias("up"), "n").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        nodes = materialize(runs.select("g", F.col("up").alias("pos"), F.ceil(F.col("n") / run).alias("n"), _joined(F.col("kids.digest")).alias("digest"), "kids"), "level")
        out.append(nodes)
        most = -(-most // run)
    return out


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """By level, lowest first: the nodes that nothing stands above."""
    return [t.where("n = 1").select("g", "pos", "digest") for t in (nodes, *levels)]


def _siblings(kids: str, place: Column) -> Column:
    """The digests of a node's other children, left to right, as bytes."""
    others = F.filter(F.col(kids), lambda k: k["pos"] != place)
    return F.aggregate(others, F.lit(b""), lambda done, k: F.concat(done, k["digest"]))


def _pushed(nodes: DataFrame, levels: list[DataFrame], start: DataFrame, keep: list[str]) -> DataFrame:
    """(g, pos, proof, subroot, *keep) of each of ``nodes``: siblings from the node up, then what ``start`` (g, proof, subroot) has for its tree."""
    tops = _tops(nodes, levels)
    above = None
    for k in range(len(levels), 0, -1):
        here = tops[k].join(start, "g").select("g", "pos", "proof", "subroot")
        here = here if above is None else here.unionByName(above)
        child = levels[k - 1].join(here, ["g", "pos"]).select("g", "proof", "subroot", "kids", F.explode("kids").alias("kid"))
        last, kept = above, keep if k == 1 else []
        above = child.select("g", F.col("kid.pos").alias("pos"), F.concat(_siblings("kids", F.col("kid.pos")), "proof").alias("proof"), "subroot", *(F.col(f"kid.{c}").alias(c) for c in kept))
        if k > 1:
            above = materialize(above, "proofs")
            if last is not None:
                discard(last)
    alone = nodes.where("n = 1").join(start, "g").select("g", "pos", "proof", "subroot", *keep)
    return alone if above is None else alone.unionByName(above)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", run: int = RUN, keep: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: its order column, leaf, subroot, root, proof, and where the proof is read from (pos of n leaves, g of groups).

    Digests are 32 bytes each; ``proof`` has those of all siblings, from the
    leaf up. ``keep``: columns over ``docs`` that go along.
    """
    keep = keep or {}
    kept = {f"keep_{i}": v for i, v in enumerate(keep.values())}
    leaves = materialize(docs.select(F.col(group).alias("group"), F.col(order).alias("order"), leaf([F.col(c) for c in fields]).alias("digest"), *(v.alias(c) for c, v in kept.items())), "hashed")
    row = F.struct("order", F.col("digest").alias("leaf"), "n", *kept)
    nodes = materialize(placed(leaves).select("g", "groups", "pos", "n", "digest", row.alias("row")), "nodes")
    discard(leaves)
    levels = _levels(nodes, ["row"], run)
    groups = (nodes.agg(F.max("groups")).first()[0]) or 0
    ends = reduce(DataFrame.unionByName, _tops(nodes, levels))
    subroots = materialize(ends.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(groups).cast("long").alias("n"), "digest", F.col("g").alias("tree"), F.col("digest").alias("own")), "subroots")
    above = _levels(subroots, ["tree", "own"], run)
    top = reduce(DataFrame.unionByName, _tops(subroots, above)).first()  # one node
    root = F.lit(bytes(top["digest"]) if top else None).cast("binary")
    start = subroots.sparkSession.createDataFrame([(0, b"", b"")], "g bigint, proof binary, subroot binary")
    starts = materialize(_pushed(subroots, above, start, ["tree", "own"]).select(F.col("tree").alias("g"), "proof", F.col("own").alias("subroot")), "starts")
    found = _pushed(nodes, levels, starts, ["row"])
    columns = [F.col(f"row.{c}").alias(name) for c, name in zip(kept, keep, strict=True)]
    return found.select(F.col("row.order").alias(order), F.col("row.leaf").alias("leaf"), "subroot", root.alias("root"), "proof", "pos", F.col("row.n").alias("n"), "g", F.lit(groups).cast("long").alias("groups"), *columns)


def climb(digest: str, proof: str, at: int, pos: int, n: int, run: int) -> tuple[str, int]:
    """The top of a tree from one node's digest and its siblings, from place ``at`` of ``proof`` on, and where the proof goes on; all in hex."""
    while n > 1:
        first = pos - pos % run
        size = min(run, n - first) - 1
        left, end = at + 64 * (pos - first), at + 64 * size
        digest = hashlib.sha256((proof[at:left] + digest + proof[left:end]).encode()).hexdigest()
        at, pos, n = end, pos // run, -(-n // run)
    return digest, at


def folded(proved: DataFrame, digest: str, run: int = RUN) -> DataFrame:
    """``proved`` (of ``manifest``) with folded_root (bytes): the root that follows from the leaf in the column ``digest`` and the row's proof."""
    places = ["pos", "n", "g", "groups"]

    @F.udf("binary")
    def fold(leaf, proof, pos, n, g, groups):
        whole = proof.hex()
        subroot, at = climb(leaf.hex(), whole, 0, pos, n, run)
        return bytes.fromhex(climb(subroot, whole, at, g, groups, run)[0])

    return proved.withColumn("folded_root", fold(digest, "proof", *places))


def op13(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = F.when(touched & F.contains("text", F.lit("\n")), leaf([cut if c == "text" else F.col(c) for c in FIELDS]))
    proved = manifest(docs, keep={"tampered": tampered}).withColumn("shown", F.coalesce("tampered", "leaf"))
    text = lambda c: F.lower(F.hex(c))
    out = folded(proved, "shown")
    return out.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same by the definition: levels by recursion, a proof from the siblings of all ancestors, tampered leaves climbing a level a step.
SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS cut,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS INTEGER)])), 4294967295) % 2 = 0 AS touched
  FROM documents, crc_table
),
hashed AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(CASE WHEN touched THEN strlen(cut) || ':' || cut ELSE strlen(text) || ':' || text END, '-')) AS shown
  FROM docs
),
leaves AS (
  SELECT r, doc_id, leaf, shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
),
tree AS (
  SELECT 0 AS level, g, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, g, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, pos // 3
),
subroots AS (SELECT g, h AS subroot FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, g AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY pos // 3
),
steps AS (
  SELECT l.r, t.level, t.pos, t.h FROM leaves l JOIN tree t ON l.g = t.g AND t.n > 1 AND l.pos // CAST(pow(3, t.level + 1) AS BIGINT) = t.pos // 3 AND l.pos // CAST(pow(3, t.level) AS BIGINT) <> t.pos
  UNION ALL
  SELECT l.r, 1000 + c.level, c.pos, c.h FROM leaves l JOIN crown c ON c.n > 1 AND l.g // CAST(pow(3, c.level + 1) AS BIGINT) = c.pos // 3 AND l.g // CAST(pow(3, c.level) AS BIGINT) <> c.pos
),
proofs AS (SELECT r, string_agg(h, '' ORDER BY level, pos) AS proof FROM steps GROUP BY r),
climbing AS (
  SELECT r, g, pos, n, false AS crowned, shown AS h, coalesce(proof, '') AS rest FROM leaves LEFT JOIN proofs USING (r)
  UNION ALL
  SELECT r, g, CASE WHEN n > 1 THEN pos // 3 ELSE g END, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE (SELECT count(*) FROM subroots) END, crowned OR n = 1,
    CASE WHEN n > 1 THEN sha256(substr(rest, 1, 64 * (pos % 3)) || h || substr(rest, 1 + 64 * (pos % 3), 64 * (least(3, n - (pos - pos % 3)) - 1 - pos % 3))) ELSE h END,
    CASE WHEN n > 1 THEN substr(rest, 1 + 64 * (least(3, n - (pos - pos % 3)) - 1)) ELSE rest END
  FROM climbing WHERE n > 1 OR NOT crowned
),
folded AS (SELECT r, h AS folded_root FROM climbing WHERE n = 1 AND crowned)
SELECT doc_id, leaf, subroot, c.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = c.h AS verified
FROM leaves JOIN subroots USING (g) JOIN folded USING (r) LEFT JOIN proofs USING (r), (SELECT h FROM crown WHERE n = 1) c
"""
