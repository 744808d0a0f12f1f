"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets are filled up to a ceiling, each source
gets a repetition rate, and each document is taken floor(rate) times plus once
more where a seeded hash of its id falls below the rate's fraction.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; without an id the text is hashed instead. Repeated rows get the same
decision. An empty table gives an empty result. Extra columns stay; planned
columns take the place of columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochweave.llm.names import quoted, unused
from epochweave.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A table of source targets of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, ceiling: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Targets share ``share`` times all sizes by weight; none is above ``ceiling``
    times its source. Sources in order of ceiling per weight: as long as the
    level reached by sharing what is left lies above a source's ceiling, that
    source is full. The level rises up to the last full source and falls
    afterwards, so its greatest value is the one all others get.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("full", ceiling * F.col("source_size"))
    order = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    total = F.sum("source_size").over(whole)
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.lit(share) * total - F.coalesce(F.sum("full").over(before), F.lit(0))) / weights_left
    target = F.least(F.col("full").cast("double"), F.max("level").over(W.partitionBy()) * F.col("weight"))
    return (
        ranked.withColumn("level", level)
        .withColumn("target", target)
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    )


def chance(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from a hash of seed and id (without one, of the text); reruns agree."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


PLANNED = ["size", "source_size", "target", "rate", "copies"]


def plan_copies(docs: DataFrame, share: float = 1.5, ceiling: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (long): how often the mix emits each row.

    The per-source table is written once; it is broadcast only if its counted
    rows are few, else joined by a shuffle whose hot source Spark may split.
    """
    row, mix_source = unused(docs, "mix_row", "mix_source")
    carry = [c for c in docs.columns if c not in PLANNED]
    sized = docs.select(F.struct(*map(quoted, carry)).alias(row), "source", word_count(F.col("text")).alias("size"), chance(F.col("doc_id"), F.col("text"), seed).alias("chance"))
    targets = materialize(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), share, ceiling, weights), "targets").withColumnRenamed("source", mix_source)
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col(mix_source)), "left")
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("chance") < F.col("rate") - whole, 1).otherwise(0)).cast("long").alias("copies")
    return joined.select(*[F.col(row).getField(c).alias(c) for c in carry], *PLANNED[:-1], copies)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each row as often as its copies say; rows of 0 copies go."""
    row, copy = unused(docs, "whole_row", "copy")
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias(row), "doc_id", "source", "text")
    planned = plan_copies(held, **options).where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return planned.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS full_size, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r WINDOW o AS (ORDER BY full_size::DOUBLE / weight, source ASC NULLS LAST)),
t AS (SELECT source, source_size, least(full_size::DOUBLE, max(level) OVER () * weight) AS target FROM l),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || name), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


def op6(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    planned = plan_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
