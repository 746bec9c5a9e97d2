"""Session-level helpers: shared scratch space and file system."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def pin_utc(spark: SparkSession) -> SparkSession:
    """All hours, days and windows of this library are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """For scans of thousands of named files, which are else listed by a task each."""
    with _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism)):
        yield


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For writes of very wide projections. HotSpot never compiles a method above 8000 bytes of bytecode, so a stage generated as one such
    method stays interpreted; within this block such a stage runs operator by operator, whose methods are split."""
    with _setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000"):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For writes: what a query has shuffled leaves the disks when it ends, not when the driver next collects garbage. Each write is
    a query of its own, so nothing reads that shuffle again."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="callmeter-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused location below the shared root."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/callmeter/{app}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Used where several results share an expensive intermediate: the lineage is
    cut and a lost executor costs nothing but a re-read.
    """
    return _at(df, fresh_path(df.sparkSession, label))


@contextmanager
def written_for(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """Like ``written``, but the files are gone after the block: what is made from them has to be written in it."""
    path = fresh_path(df.sparkSession, label)
    try:
        yield _at(df, path)
    finally:
        Folder(df.sparkSession).drop(path)


def _at(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """The few file-system calls needed around tables (Hadoop file system API)."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        jpath = self._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self._conf), jpath

    def exists(self, path: str) -> bool:
        fs, jpath = self._open(path)
        return bool(fs.exists(jpath))

    def children(self, path: str) -> list[str]:
        fs, jpath = self._open(path)
        if not fs.exists(jpath):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(jpath))

    def drop(self, path: str) -> bool:
        fs, jpath = self._open(path)
        return bool(fs.delete(jpath, True))


def has_rows_on_disk(spark: SparkSession, path: str) -> bool:
    """True when a table folder exists and holds something besides markers."""
    return any(not n.startswith(("_", ".")) for n in Folder(spark).children(path))
