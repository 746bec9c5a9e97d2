"""Hourly rollups and the panels that read them.

A rollup holds additive partial rows, partitioned like the records by *source*
hour, so replacing one source hour replaces its share of every rollup. Readers
always sum again, and filter on the hour of the event itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.functions import dims, metrics
from callmeter.functions.predicates import panel_scope
from callmeter.operators.topk import top_rows
from callmeter.operators.versions import merge_partials
from callmeter.params import PanelFilter
from callmeter.schema import PARTITIONS

# Keys and measures of the media-address rollup.
MEDIA_KEYS = [
    "day", "hour", "entity", "term_media_ip", "term_ip", "term_carrier_name",
    "term_trunk_group_name", "orig_trunk_group_name", "sip_code", "reason",
    "stir_attest", "term_state", "term_ratecenter",
]
MEDIA_PARTS = [
    "attempts", "completions", "billed_seconds", "revenue_units", "cost_units",
    "pdd_sum", "pdd_count", "mos_units", "mos_count",
]
REASON_KEYS = [
    "day", "hour", "entity", "orig_trunk_group_name", "term_state",
    "billed_prefix", "sip_code", "reason",
]
REASON_PARTS = ["attempts"]

_NONE_FILLED = (
    "term_media_ip", "term_ip", "term_carrier_name", "term_trunk_group_name",
    "orig_trunk_group_name", "reason",
)
_UNKNOWN_FILLED = ("stir_attest", "term_state", "term_ratecenter")


def _event_hour() -> list[Column]:
    return [
        F.to_date("event_time").alias("day"),
        F.date_trunc("hour", "event_time").alias("hour"),
    ]


def _source(records: DataFrame) -> list[str]:
    """Source-hour partition columns, where the records have them."""
    return [p for p in PARTITIONS if p in records.columns and p != "entity"]


def media_rollup(records: DataFrame) -> DataFrame:
    """Traffic, money and quality per event hour and media route."""
    source = _source(records)
    named = records.select(
        *_event_hour(), "entity", "sip_code",
        *[dims.filled(c, dims.NONE).alias(c) for c in _NONE_FILLED],
        *[dims.filled(c, dims.UNKNOWN).alias(c) for c in _UNKNOWN_FILLED],
        "orig_billed_duration", "orig_cost", "term_cost", "pdd", "mos_avg", *source,
    )
    scored, rung = F.col("mos_avg") > 0, F.col("pdd") > 0
    zero = F.lit(0).cast("long")
    return named.groupBy(*MEDIA_KEYS, *source).agg(
        *[F.coalesce(p, zero).alias(n) for p, n in zip(metrics.partial_metrics(), metrics.PARTS)],
        F.coalesce(F.sum(F.when(rung, F.col("pdd").cast("long"))), zero).alias("pdd_sum"),
        F.count(F.when(rung, 1)).alias("pdd_count"),
        F.coalesce(F.sum(F.when(scored, metrics.to_units("mos_avg"))), zero).alias("mos_units"),
        F.count(F.when(scored, 1)).alias("mos_count"),
    )


def reason_rollup(records: DataFrame) -> DataFrame:
    """Attempts per event hour, trunk, state, rated prefix, SIP code and reason."""
    source = _source(records)
    named = records.select(
        *_event_hour(), "entity",
        dims.filled("orig_trunk_group_name", dims.NONE).alias("orig_trunk_group_name"),
        dims.non_null("term_state", "").alias("term_state"),
        dims.non_null("orig_billed_prefix", "").alias("billed_prefix"),
        "sip_code", dims.release_reason().alias("reason"), *source,
    )
    return named.groupBy(*REASON_KEYS, *source).agg(F.count(F.lit(1)).alias("attempts"))


def merged_media(rollup: DataFrame) -> DataFrame:
    """Merge-on-read of the media rollup, with money and score as numbers."""
    merged = merge_partials(rollup, MEDIA_KEYS, MEDIA_PARTS)
    return merged.select(
        *MEDIA_KEYS, "attempts", "completions", "billed_seconds",
        metrics.from_units(F.col("revenue_units")).alias("revenue"),
        metrics.from_units(F.col("cost_units")).alias("cost"),
        "pdd_sum", "pdd_count",
        metrics.from_units(F.col("mos_units")).alias("mos_sum"), "mos_count",
    )


def merged_reasons(rollup: DataFrame) -> DataFrame:
    return merge_partials(rollup, REASON_KEYS, REASON_PARTS)


# --- panels over the media rollup -------------------------------------------

_ROUTE = [
    "entity", "orig_trunk_group_name", "term_carrier_name",
    "term_trunk_group_name", "term_ip", "term_media_ip",
]
_MEDIA_FILTERS = ("entity", "origin_trunk", "vendor", "trunk", "media_ip")


def _routed(rollup: DataFrame, flt: PanelFilter) -> DataFrame:
    scope = panel_scope(rollup, flt, "hour", _MEDIA_FILTERS)
    return scope.where(F.col("term_media_ip") != dims.NONE)


def _by_size(size: str, keys: list[str]) -> list[Column]:
    return [F.desc(size), *[F.asc(k) for k in keys]]


def route_map(rollup: DataFrame, flt: PanelFilter = PanelFilter(), limit: int | None = 1000) -> DataFrame:
    """Busiest full routes with answer rate."""
    answered, all_calls = F.sum("completions"), F.sum("attempts")
    routes = _routed(rollup, flt).groupBy(*_ROUTE).agg(
        F.max("hour").alias("last_seen"),
        all_calls.alias("cdrs"),
        answered.alias("answered"),
        (all_calls - answered).alias("failed"),
        metrics.round2(metrics.ratio_pct(answered, all_calls)).alias("answer_rate"),
    )
    return top_rows(routes, _by_size("cdrs", _ROUTE), limit)


def busiest_media_ips(
    rollup: DataFrame, flt: PanelFilter = PanelFilter(), limit: int | None = 50
) -> DataFrame:
    """Most used media addresses per incoming trunk and vendor trunk."""
    keys = ["term_media_ip", "orig_trunk_group_name", "term_carrier_name", "term_trunk_group_name"]
    used = _routed(rollup, flt).groupBy(*keys).agg(
        F.max("hour").alias("last_seen"), F.sum("attempts").alias("cdrs")
    )
    return top_rows(used, _by_size("cdrs", keys), limit)


def failures_by_route(
    rollup: DataFrame, flt: PanelFilter = PanelFilter(), limit: int | None = 500
) -> DataFrame:
    """Unanswered calls per route, SIP code and reason."""
    keys = [
        "term_media_ip", "orig_trunk_group_name", "term_carrier_name",
        "term_trunk_group_name", "sip_code", "reason",
    ]
    failed = (
        _routed(rollup, flt).where(F.col("sip_code") != 200)
        .groupBy(*keys).agg(F.sum("attempts").alias("failed_cdrs"))
    )
    return top_rows(failed, _by_size("failed_cdrs", keys), limit)


# Each pick list narrows by the ones before it.
_CASCADE = {
    "entity": ("entity", ()),
    "origin_trunk": ("orig_trunk_group_name", ("entity",)),
    "vendor": ("term_carrier_name", ("entity", "origin_trunk")),
    "trunk": ("term_trunk_group_name", ("entity", "origin_trunk", "vendor")),
    "media_ip": ("term_media_ip", ("entity", "origin_trunk", "vendor", "trunk")),
}


def filter_values(rollup: DataFrame, name: str, flt: PanelFilter = PanelFilter()) -> DataFrame:
    """Ordered choices of one panel filter, given the filters that precede it."""
    if name == "sip_code":
        codes = panel_scope(rollup, flt, "hour", ()).select("sip_code").distinct()
        return codes.orderBy("sip_code").select(F.col("sip_code").cast("string").alias("value"))
    column, before = _CASCADE[name]
    if name == "entity":
        choices = rollup
    else:
        choices = panel_scope(rollup, flt, "hour", before).where(F.col(column) != dims.NONE)
    return choices.select(F.col(column).alias("value")).distinct().orderBy("value")


# --- SIP reason × customer × state grid --------------------------------------

GRID_KEYS = ["customer", "state", "code", "sip_reason"]
NO_TRAFFIC = "(no traffic)"
DASH = "—"


def _reason_scope(rollup: DataFrame, flt: PanelFilter) -> DataFrame:
    scope = panel_scope(rollup, flt, "hour", ("entity", "origin_trunk"))
    return scope.where(F.col("orig_trunk_group_name") != dims.NONE)


def reason_grid_traffic(rollup: DataFrame, flt: PanelFilter = PanelFilter()) -> DataFrame:
    """Attempts per trunk, state, rated prefix and outcome."""
    named = _reason_scope(rollup, flt).where(F.col("term_state") != "").select(
        F.col("orig_trunk_group_name").alias("customer"),
        F.col("term_state").alias("state"),
        dims.filled("billed_prefix", DASH).alias("code"),
        F.concat(F.col("sip_code").cast("string"), F.lit(" - "), F.col("reason")).alias("sip_reason"),
        "attempts",
    )
    return named.groupBy(*GRID_KEYS).agg(F.sum("attempts").alias("attempts"))


def reason_grid_gaps(rollup: DataFrame, flt: PanelFilter = PanelFilter()) -> DataFrame:
    """Trunk and state pairs without any traffic.

    Every trunk carries the set of its own states; the gaps are the listed
    states minus those, exploded. Nothing is joined: the state list reaches the
    rows as a scalar subquery.
    """
    in_states = panel_scope(rollup, flt, "hour", ("entity",)).where(F.col("term_state") != "")
    listed = in_states.select("term_state").distinct().agg(
        F.array_sort(F.collect_list("term_state")).alias("states")
    )
    own = (
        _reason_scope(rollup, flt)
        .select("orig_trunk_group_name", F.nullif(F.col("term_state"), F.lit("")).alias("own")).distinct()
        .groupBy(F.col("orig_trunk_group_name").alias("customer"))
        .agg(F.collect_list("own").alias("own_states"))
    )
    absent = F.array_except(listed.scalar(), F.col("own_states"))
    return own.select("customer", F.explode(absent).alias("state"))


def pair_totals(rollup: DataFrame, flt: PanelFilter = PanelFilter()) -> DataFrame:
    return (
        _reason_scope(rollup, flt).where(F.col("term_state") != "")
        .groupBy(F.col("orig_trunk_group_name").alias("customer"), F.col("term_state").alias("state"))
        .agg(F.sum("attempts").alias("pair_attempts"))
    )


def with_pair_share(traffic: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of each row in its trunk and state pair, in percent.

    A join on the pair rather than a window: AQE can split a pair that holds
    most of the rows.
    """
    share = metrics.round2(metrics.ratio_pct(F.col("attempts"), F.col("pair_attempts")))
    return (
        traffic.join(totals, ["customer", "state"])
        .withColumn("pct_of_pair", share)
        .drop("pair_attempts")
    )


def reason_grid(
    rollup: DataFrame, flt: PanelFilter = PanelFilter(), limit: int | None = 5000
) -> DataFrame:
    """The whole grid: traffic rows by size with their share, then the gap rows."""
    order = [F.desc("attempts"), *[F.asc(k) for k in GRID_KEYS]]
    traffic = reason_grid_traffic(rollup, flt)
    totals = pair_totals(rollup, flt)
    if limit is not None:
        # Shares are needed for the rows that are shown only. The limit gives their size to
        # the optimizer, which broadcasts them under its threshold and shuffles them above.
        traffic = traffic.orderBy(*order).limit(limit)
    gaps = reason_grid_gaps(rollup, flt).select(
        "customer", "state",
        F.lit(DASH).alias("code"),
        F.lit(NO_TRAFFIC).alias("sip_reason"),
        F.lit(0).cast("long").alias("attempts"),
        F.lit(0.0).alias("pct_of_pair"),
    )
    columns = [*GRID_KEYS, "attempts", "pct_of_pair"]
    grid = with_pair_share(traffic, totals).select(*columns).unionByName(gaps)
    return top_rows(grid, order, limit)


def hour_counts(records: DataFrame) -> DataFrame:
    """Rows per source hour."""
    return records.groupBy("entity", "file_hour").agg(F.count(F.lit(1)).alias("rows"))
