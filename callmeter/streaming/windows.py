"""Event-time windows over a stream, and replayable table sinks for them.

Two ways to hourly windows: ``hourly_windows`` keeps open windows as state and drops what comes too late; ``exact_windows`` emits additive
partials for every batch, so nothing is dropped and no state grows, and tells late rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from callmeter.operators.versions import latest_version
from callmeter.runtime import Folder


def hourly_windows(
    stream: DataFrame, time_column: str, keys: list[str], measures: dict[str, Column], delay: str = "1 hour"
) -> DataFrame:
    """One-hour tumbling windows (UTC); rows later than ``delay`` may be dropped.

    Watermarks need a zoned timestamp, so a zone-less column is cast first.
    """
    timed = stream.withColumn(time_column, F.col(time_column).cast("timestamp"))
    grouped = timed.withWatermark(time_column, delay).groupBy(
        F.window(time_column, "1 hour").alias("_window"), *keys
    )
    named = [measure.alias(name) for name, measure in measures.items()]
    return grouped.agg(*named).select(F.col("_window.start").alias("hour"), *keys, *measures)


def write_batches(
    result: DataFrame, path: str, checkpoint: str, mode: str = "update",
    available_now: bool = True, interval: str = "60 seconds",
) -> StreamingQuery:
    """Write every micro-batch to its own folder.

    A replayed batch overwrites its folder, so a restart changes nothing.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def current_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest value per key of an update-mode result written by :func:`write_batches`."""
    batches = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    return latest_version(batches, keys, ["batch_id"]).drop("batch_id")


def partial_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of per-batch partials; their readers sum."""
    return spark.read.parquet(path).drop("batch_id")


_PROGRESS = T.StructType([T.StructField("newest", T.TimestampType())])


def exact_windows(
    stream: DataFrame, time_column: str, keys: list[str], measures: dict[str, Column], path: str, checkpoint: str,
    delay: str = "1 hour", available_now: bool = True, interval: str = "60 seconds",
) -> StreamingQuery:
    """One-hour tumbling windows (UTC) that stay exact however late a row comes.

    Every micro-batch leaves one partial row per window and key under ``partials/``; ``measures`` have to be additive, and
    readers add them (:func:`summed_windows`). A row is late when its window had ended ``delay`` before the newest event of
    all earlier batches: it counts like any other, and again in ``late_rows``, so a consumer sees which closed windows changed and by how much. The only state is that newest
    event, one value per batch under ``progress/``; a replayed batch reads the one before its own and writes the same again. A batch's progress is
    written after its partials: a batch that died in between is replayed.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        before = f"{path}/progress/batch_id={batch_id - 1}"
        seen = spark.read.schema(_PROGRESS).parquet(before).first()["newest"] if Folder(spark).exists(before) else None
        timed = batch.withColumn(time_column, F.col(time_column).cast("timestamp"))
        hour = F.date_trunc("hour", time_column)
        known = F.lit(seen).cast("timestamp")
        late = hour + F.expr("INTERVAL 1 HOUR") <= known - F.expr(f"INTERVAL {delay}")
        partial = timed.groupBy(hour.alias("hour"), *keys).agg(
            *[m.alias(n) for n, m in measures.items()], F.count(F.when(late, 1)).alias("late_rows"), F.max(time_column).alias("newest"),
        )
        own = f"{path}/partials/batch_id={batch_id}"
        partial.write.mode("overwrite").parquet(own)
        newest = spark.read.schema(partial.schema).parquet(own).agg(F.greatest(F.max("newest"), known).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/progress/batch_id={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(**trigger).start()


def summed_windows(spark: SparkSession, path: str, keys: list[str], measures: list[str]) -> DataFrame:
    """The windows of :func:`exact_windows`: hour, keys, measures, and how many rows came late."""
    partials = spark.read.parquet(f"{path}/partials")
    return partials.groupBy("hour", *keys).agg(*[F.sum(m).alias(m) for m in (*measures, "late_rows")])


def late_arrivals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Side output: batch, window and key of rows that came after their window had closed, with their number."""
    partials = spark.read.parquet(f"{path}/partials").where("late_rows > 0")
    return partials.select(F.col("batch_id").cast("long").alias("batch_id"), "hour", *keys, "late_rows")
