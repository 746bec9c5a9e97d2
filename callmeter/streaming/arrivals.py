"""Continuous loading of newly arriving hourly files, and rollups per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callmeter.plans.ingest import IngestOptions, ingest_all
from callmeter.plans.rollups import media_rollup
from callmeter.runtime import Folder
from callmeter.sources.landing import Landing, canonical_files, listing, plain_path, too_young
from callmeter.sources.store import CallStore

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def new_files(spark: SparkSession, landing: Landing, files_per_batch: int = 1000) -> DataFrame:
    """Stream of file paths, oldest first; each path appears once."""
    arrived = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz")
        .option("maxFilesPerTrigger", files_per_batch).option("latestFirst", False)
        .load(landing.root)
    )
    return arrived.select(plain_path(F.col("path")).alias("file_path"))


def load_paths(
    store: CallStore, landing: Landing, paths: list[str], now: datetime, options: IngestOptions
) -> DataFrame | None:
    """Load some paths together with earlier ones that were still being written.

    A file younger than the minimum age is noted as ``waiting`` in the log and
    taken up by a later batch, since the stream never offers a path twice.
    """
    manifest = store.manifest
    noted = [r["file_path"] for r in manifest.latest.where("status = 'waiting'").select("file_path").collect()]
    folder = Folder(store.spark)
    present = [p for p in dict.fromkeys(noted + paths) if folder.exists(p)]
    if not present:
        return None
    # An hour may have several part files, of which the stream offers some now and
    # some later; it is replaced as a whole, so all that are there come along.
    folders = sorted({p.rsplit("/", 1)[0] for p in present})
    beside = canonical_files(listing(store.spark, folders), landing)
    offered = store.spark.createDataFrame([(p,) for p in present], "file_path string")
    hours = beside.join(offered, "file_path", "left_semi").select("entity", "file_hour").distinct()
    files = beside.join(hours, ["entity", "file_hour"], "left_semi")
    young = too_young(now, options.min_age_seconds)
    waiting = files.where(young).select(
        "file_path", "entity", "file_hour", "source_size", "source_mtime_ms",
        F.lit("waiting").alias("status"), F.lit("file may still be written").alias("message"),
    )
    manifest.append(waiting, now, seq=0)
    return ingest_all(store, files.where(~young), now, options)


def watch_landing(
    store: CallStore, landing: Landing, checkpoint: str, options: IngestOptions = IngestOptions(),
    once: bool = False, interval: str = "60 seconds", files_per_batch: int = 1000,
    clock: Callable[[], datetime] = _utc_now,
) -> StreamingQuery:
    """Load arriving files; ``once`` drains what is there and stops.

    While it runs, a tick at every trigger has waiting files looked at again, so a young file
    is loaded once it is old enough, whether or not another one arrives.

    The checkpoint remembers offered files and the load is idempotent, so a
    batch replayed after a crash skips or replaces what it had done. Files
    rewritten later are found by the batch cycle, which compares fingerprints.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        # At most ``files_per_batch`` names; contents never leave the executors.
        paths = [r["file_path"] for r in batch.where("file_path IS NOT NULL").collect()]
        load_paths(store, landing, paths, clock(), options)

    trigger = {"availableNow": True} if once else {"processingTime": interval}
    arrived = new_files(store.spark, landing, files_per_batch)
    if not once:
        ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
        arrived = arrived.unionByName(ticks.select(F.lit(None).cast("string").alias("file_path")))
    return (
        arrived.writeStream
        .option("checkpointLocation", checkpoint).foreachBatch(load).trigger(**trigger).start()
    )


def stream_media_partials(
    records: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Media rollup of every micro-batch as partial rows (read them with a merge)."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        media_rollup(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": "60 seconds"}
    return (
        records.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(keep).trigger(**trigger).start()
    )
