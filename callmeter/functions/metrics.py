"""The metric block shared by every report.

Money is summed as fixed-point integers (1e-8 units): sums do not depend on the
order in which partitions arrive, buffers stay 8-byte longs inside whole-stage
code generation, and partial sums can be added again at any later level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_UNIT = 100_000_000          # fixed-point units per currency unit
MONEY_STEP = 10_000               # units per reported 4-decimal step

# Additive parts, in the order they are carried around.
PARTS = ("attempts", "completions", "billed_seconds", "revenue_units", "cost_units")
METRICS = ("attempts", "completions", "asr_pct", "minutes", "revenue", "cost", "margin")


def to_units(amount) -> Column:
    """Money (or any score) as a fixed-point long."""
    return F.floor(F.col(amount) * float(MONEY_UNIT) + 0.5)


def from_units(units: Column) -> Column:
    return units / float(MONEY_UNIT)


def hundredths(value: Column) -> Column:
    """A non-negative double as a whole number of hundredths, half up."""
    return F.floor(value * 100.0 + 0.5)


def round2(value: Column) -> Column:
    """Round a non-negative double to 2 places without leaving double arithmetic."""
    return hundredths(value) / 100.0


def ratio_pct(part: Column, whole: Column) -> Column:
    """100·part/whole, NULL for an empty whole."""
    return 100.0 * part / F.nullif(whole, F.lit(0))


def money_steps(units: Column) -> Column:
    """Fixed-point units as whole 4-decimal steps, half away from zero."""
    half = F.when(units < 0, -(MONEY_STEP // 2)).otherwise(MONEY_STEP // 2)
    shifted = (units + half).cast("long")
    return F.call_function("div", shifted, F.lit(MONEY_STEP).cast("long"))


def money(units: Column) -> Column:
    return money_steps(units) / 10_000.0


def partial_metrics() -> list[Column]:
    """Aggregates over raw records that give the additive parts."""
    answered = F.col("sip_code") == 200
    return [
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(answered, 1)).alias("completions"),
        F.sum(F.when(answered, F.col("orig_billed_duration").cast("long"))).alias("billed_seconds"),
        F.sum(to_units("orig_cost")).alias("revenue_units"),
        F.sum(to_units("term_cost")).alias("cost_units"),
    ]


def merge_metrics() -> list[Column]:
    """Aggregates over partial rows that give the parts of a coarser level."""
    return [F.sum(name).alias(name) for name in PARTS]


def finished_metrics() -> list[Column]:
    """Reported columns from the additive parts of one group.

    ``minutes`` is NULL for a group without an answered call, and the margin is
    the rounded difference, not the difference of the rounded amounts.
    """
    c = F.col
    return [
        c("attempts"),
        c("completions"),
        round2(ratio_pct(c("completions"), c("attempts"))).alias("asr_pct"),
        round2(c("billed_seconds") / 60.0).alias("minutes"),
        money(c("revenue_units")).alias("revenue"),
        money(c("cost_units")).alias("cost"),
        money(c("revenue_units") - c("cost_units")).alias("margin"),
    ]


def summed_metrics() -> list[Column]:
    """Totals over groups: sums of the *rounded* group values, exact as integers."""
    c = F.col
    zero = F.lit(0).cast("long")

    def total(steps: Column, per_unit: float) -> Column:
        return F.coalesce(F.sum(steps), zero) / per_unit

    attempts = F.coalesce(F.sum("attempts"), zero)
    completions = F.coalesce(F.sum("completions"), zero)
    return [
        attempts.alias("attempts"),
        completions.alias("completions"),
        F.coalesce(round2(ratio_pct(completions, attempts)), F.lit(0.0)).alias("asr_pct"),
        total(hundredths(c("billed_seconds") / 60.0), 100.0).alias("minutes"),
        total(money_steps(c("revenue_units")), 10_000.0).alias("revenue"),
        total(money_steps(c("cost_units")), 10_000.0).alias("cost"),
        total(money_steps(c("revenue_units") - c("cost_units")), 10_000.0).alias("margin"),
    ]


def with_margin_pct(rows: DataFrame) -> DataFrame:
    """Margin as a percentage of revenue (NULL without revenue)."""
    pct = 100.0 * F.col("margin") / F.nullif(F.col("revenue"), F.lit(0.0))
    return rows.withColumn("margin_pct", F.round(pct, 1))


def with_row_flags(rows: DataFrame) -> DataFrame:
    """Loss or gain by the sign of the margin, and the answer-rate band."""
    margin, asr = F.coalesce("margin", F.lit(0.0)), F.coalesce("asr_pct", F.lit(0.0))
    return rows.withColumns({
        "margin_flag": F.when(margin < 0, "loss").when(margin > 0, "gain").otherwise("even"),
        "asr_flag": F.when(asr < 15, "warn").when(asr >= 40, "good").otherwise("fair"),
    })
