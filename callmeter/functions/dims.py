"""Dimension normalisers: what an absent value is called in which table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN, UNRATED, UNSIGNED = "(none)", "?", "(unrated)", "(unsigned)"
NOT_PROVIDED = "Not provided"


def filled(col, default: str) -> Column:
    """The value, or ``default`` where it is NULL or empty."""
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))


def non_null(col, default: str) -> Column:
    return F.coalesce(F.col(col), F.lit(default))


def rated_code(col) -> Column:
    """Exact rated prefix, never shortened."""
    return F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit(UNRATED))


# --- report dimensions ----------------------------------------------------

def customer() -> Column:
    return non_null("orig_trunk_group_name", NONE).alias("customer")


def code() -> Column:
    return rated_code("orig_billed_prefix").alias("code")


def term_code() -> Column:
    return rated_code("term_billed_prefix").alias("term_code")


def state() -> Column:
    return non_null("term_state", UNKNOWN).alias("state")


def ratecenter() -> Column:
    return non_null("term_ratecenter", UNKNOWN).alias("ratecenter")


def x5u_url() -> Column:
    return filled("stir_x5u", UNSIGNED).alias("x5u_url")


def attest() -> Column:
    return filled("stir_attest", UNKNOWN).alias("attest")


# --- detail and rollup dimensions -----------------------------------------

def release_reason() -> Column:
    """Switch reason, else SIP reason, else a placeholder."""
    first = [F.nullif(F.col(c), F.lit("")) for c in ("reason", "sip_reason")]
    return F.coalesce(*first, F.lit(NOT_PROVIDED))


def outcome() -> Column:
    return F.when(F.col("sip_code") == 200, "Answered").otherwise("Failed")


# --- state from the rated prefix ------------------------------------------

def area_code(prefix) -> Column:
    """First three digits after one leading country code ``1``."""
    return F.substring(F.regexp_replace(F.col(prefix), "^1", ""), 1, 3)


def area_code_lookup(area_codes: DataFrame) -> DataFrame:
    """One row per three-digit area code, so at most 1000 rows by construction."""
    return (
        area_codes.where(F.col("npa").rlike("^[0-9]{3}$"))
        .groupBy("npa").agg(F.min("state").alias("mapped_state"))
    )


def with_billed_state(
    records: DataFrame, area_codes: DataFrame, prefix: str, raw_state: str, name: str = "state"
) -> DataFrame:
    """Add the state of the rated prefix.

    Falls back to the raw state unless that is blank or the toll-free bucket,
    and to ``?`` after that.
    """
    raw = F.trim(F.col(raw_state))
    usable = F.when((raw != "") & (raw != "tfree"), raw)
    lookup = F.broadcast(area_code_lookup(area_codes))
    return (
        records.withColumn("npa", area_code(prefix))
        .join(lookup, "npa", "left")
        .withColumn(name, F.coalesce("mapped_state", usable, F.lit(UNKNOWN)))
        .drop("npa", "mapped_state")
    )
