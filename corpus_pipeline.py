"""The corpus pipeline: quality, lines, near duplicates, mixing, packing.

What a stage returns must be written before the next stage is called, as
``run`` does: the next stage deletes the intermediate tables of those before
it, but for any that its ``docs`` still reads. Each thread has tables of its
own, so pipelines that run side by side do not meet.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from epochweave.llm import jaccard, lines, mixing, packing, quality
from epochweave.session import materialize, release, scope, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made = threading.local()


def _tables() -> list[str]:
    """The folders that this thread's stages have made and not deleted yet."""
    return _made.__dict__.setdefault("tables", [])


def _tidy(stage: Stage) -> Stage:
    """``stage``, which first deletes what earlier stages have left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _tables(), docs)
        with scope(_tables()):
            return stage(spark, docs, sf_dir)

    return run


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules keep."""
    return quality.keep_good(docs)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly; every document stays, empty ones too."""
    return lines.drop_lines(docs, count=None)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix_documents(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeats included, with their sequence and place there."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]
#: MinHash lines, components and token packing are beyond SQL: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
