"""Ordering and top-k operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(sort_by: str, sort_dir: str, ties: list[str]) -> list[Column]:
    """A total order: the sort field, then every tie-breaker ascending, NULLs last."""
    lead = F.col(sort_by).asc_nulls_last() if sort_dir == "asc" else F.col(sort_by).desc_nulls_last()
    return [lead] + [F.col(t).asc_nulls_last() for t in ties if t != sort_by]


def top_rows(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Global order with an optional limit (planned as one distributed top-k)."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def top_rows_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, spread_by: list[str], pieces: int = 64
) -> DataFrame:
    """First ``limit`` rows of every group, exact for groups of any size.

    A group is first cut into ``pieces`` by a hash of ``spread_by`` and each
    piece keeps its own best rows; only those compete in the second step, so no
    task ever sorts a whole large group.
    """
    piece = F.pmod(F.xxhash64(*spread_by), F.lit(pieces))
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_piece", piece)
        .withColumn("_rank", F.row_number().over(local)).where(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(overall)).where(F.col("_rank") <= limit)
        .drop("_piece", "_rank")
    )


def with_row_count(rows: DataFrame, counted: DataFrame, name: str) -> DataFrame:
    """Attach the row count of ``counted`` as a scalar subquery (no window, no join)."""
    total = counted.agg(F.count(F.lit(1)).alias(name)).scalar()
    return rows.withColumn(name, total)
