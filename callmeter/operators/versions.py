"""Reading append-only tables: last version per key, and sums of additive partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of every key.

    Catalyst limits each key to one row per task before the shuffle (window
    group limit), so a key with very many versions stays cheap.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(v).desc_nulls_last() for v in version])
    return (
        rows.withColumn("_version", F.row_number().over(newest))
        .where(F.col("_version") == 1)
        .drop("_version")
    )


def merge_partials(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Sum additive partial rows that share a key."""
    return rows.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in parts])
