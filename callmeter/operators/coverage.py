"""Which source hours or days of a request are not loaded yet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def needed_days(spark: SparkSession, entities, first: date, last: date) -> DataFrame:
    """Every (entity, day) of a request."""
    return spark.createDataFrame([(e,) for e in entities], "entity string").select(
        "entity", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    )


def missing_hours(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Present files whose loaded fingerprint is absent or differs.

    ``files`` and ``manifest`` (already one row per file) carry file_path,
    entity, file_hour, source_size and source_mtime_ms.
    """
    known = manifest.select(
        "file_path",
        F.col("source_size").alias("loaded_size"),
        F.col("source_mtime_ms").alias("loaded_mtime_ms"),
    )
    covered = F.coalesce(
        (F.col("loaded_size") == F.col("source_size"))
        & (F.col("loaded_mtime_ms") == F.col("source_mtime_ms")),
        F.lit(False),
    )
    return files.join(known, "file_path", "left").where(~covered).select("entity", "file_hour")


def missing_days(needed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Needed (entity, day) pairs without any loaded hour."""
    loaded = manifest.select("entity", F.to_date("file_hour").alias("day")).distinct()
    return needed.join(loaded, ["entity", "day"], "left_anti")


def missing_coverage(
    files: DataFrame, manifest: DataFrame, entities, first: date, last: date
) -> DataFrame:
    """What a request still lacks: one row per missing hour, or per missing day
    where no raw file of the request is left (archived input)."""
    day = F.to_date("file_hour")
    in_request = F.col("entity").isin(*entities) & day.between(F.lit(first), F.lit(last))
    present = files.where(in_request)
    by_hour = missing_hours(present, manifest)
    if present.limit(1).count():
        return by_hour
    by_day = missing_days(needed_days(files.sparkSession, entities, first, last), manifest)
    return by_day.select("entity", F.col("day").cast("timestamp").alias("file_hour"))
