"""Session defaults, table reading and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Files of a shuffle go as soon as the query that made it has ended, instead of when the driver collects its garbage.
_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The lists of ``scope`` that are open in this thread.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


def local_session(cpus: int = 8, memory: str = "8g", app: str = "epochweave") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; ``sf_dir`` may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``; a temporary one only where all tasks run on this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_BRIEF, None)
    spark.conf.set(_BRIEF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BRIEF)
        else:
            spark.conf.set(_BRIEF, before)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and lost executors lose nothing.

    The table stays until ``discard``, or until ``release`` of the scope it was made in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/epochweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.parquet(path)
    for tables in _open.get():
        tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder of any store that Spark writes to."""
    at, files = _file_system(spark, path)
    files.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store; none where there is no such folder."""
    at, files = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.scratch)


@contextmanager
def scope(tables: list[str]) -> Iterator[None]:
    """Collects in ``tables`` the folders of all intermediate tables that this thread makes inside."""
    before = _open.set((*_open.get(), tables))
    try:
        yield
    finally:
        _open.reset(before)


def release(spark: SparkSession, tables: list[str], reads: DataFrame | None = None) -> None:
    """Delete the collected tables, but for those that ``reads`` is made of."""
    used = {f.rsplit("/", 1)[0] for f in reads.inputFiles()} if reads is not None and tables else set()
    stay = [p for p in tables if any(u.endswith(p.split("://")[-1].lstrip("/")) for u in used)]
    for path in tables:
        if path not in stay:
            delete(spark, path)
    tables[:] = stay


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
