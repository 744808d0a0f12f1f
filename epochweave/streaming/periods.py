"""Streams of key-value operations: latest value per key, and layered state by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epochweave.state.manager import StateManager

OUT = "key string, period bigint, snapshot bigint, intermediate bigint, delta bigint"


class PeriodState(StatefulProcessor):
    """Snapshot, intermediate and delta of one key; layers move on when its period number rises."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.layers = handle.getValueState("layers", "period bigint, snapshot bigint, has_intermediate boolean, intermediate bigint, has_delta boolean, delta bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        period, snapshot, has_i, i, has_d, d = self.layers.get() or (0, None, False, None, False, None)
        pdf = pd.concat(list(rows)).sort_values("height", kind="stable")
        for height, value in zip(pdf["height"].tolist(), pdf["value"].astype(object).where(pdf["value"].notna(), None).tolist(), strict=True):
            for _ in range(min(2, height // self.length - period)):
                if has_i:
                    snapshot = i
                has_i, i, has_d, d = has_d, d, False, None
            period = max(period, height // self.length)
            has_d, d = True, None if value is None else int(value)
        self.layers.update((period, snapshot, has_i, i, has_d, d))
        yield pd.DataFrame({"key": [key[0]], "period": [period], "snapshot": [snapshot], "intermediate": [i], "delta": [d]})

    def close(self) -> None:
        pass


def rotate_stream(ops: DataFrame, period: int) -> DataFrame:
    """Layers of each key after each batch of a stream of (key, height, value); a null value is a tombstone."""
    return ops.groupBy("key").transformWithStateInPandas(PeriodState(period), OUT, "Update", "None")


class NextEpoch(StatefulProcessor):
    """The epoch that a job's next group must start at; groups that start elsewhere are reported."""

    def __init__(self, resume: int):
        self.resume = resume

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "epoch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.expected.get()
        expected = known[0] if known else (self.resume + 1 if self.resume else None)
        found = []
        pdf = pd.concat(list(rows)).sort_values("start_epoch", kind="stable")
        for start, count in zip(pdf["start_epoch"].tolist(), pdf["epochs"].tolist(), strict=True):
            if expected is not None and start != expected:
                found.append((key[0], int(start), int(expected)))
            expected = start + count
        self.expected.update((int(expected),))
        yield pd.DataFrame(found, columns=["job", "start_epoch", "expected"])

    def close(self) -> None:
        pass


def contiguity_stream(groups: DataFrame, resume: int = 0) -> DataFrame:
    """(job, start_epoch, expected) of the groups of a stream of (job, start_epoch, epochs) that do not start where the one before of their job ends.

    After a checkpoint at height ``resume``, other than 0, the first group of a
    job must start right behind it. The groups of a batch are taken in order;
    the next one is expected behind the last, whether that was in place or not.
    """
    return groups.groupBy("job").transformWithStateInPandas(NextEpoch(resume), "job string, start_epoch bigint, expected bigint", "Append", "None")


def commit_batches(manager: StateManager, each: Callable | None = None):
    """A ``foreachBatch`` sink: every micro-batch of operations is one write and one commit.

    The batch's number is saved with the version that holds it, so a batch that
    comes again, even after a restart, is skipped.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= manager.state.batch:
            return
        manager.set(batch)
        root = manager.commit(batch_id)
        if each:
            each(batch_id, root)

    return run


def epoch_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Blocks and pivots by event time, closed behind a watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("event_type") == "purchase").alias("pivots"))
