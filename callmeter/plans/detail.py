"""Newest single calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.functions import dims
from callmeter.functions.predicates import panel_scope
from callmeter.operators.topk import top_rows
from callmeter.params import PanelFilter

# Newest first; call ids may repeat, so the start time settles the rest.
_NEWEST = (F.desc, "event_time"), (F.asc, "callid"), (F.asc, "call_start_time")


def _newest(records: DataFrame, limit: int | None) -> DataFrame:
    return top_rows(records, [f(c) for f, c in _NEWEST], limit)


def call_detail(
    records: DataFrame, flt: PanelFilter = PanelFilter(), limit: int | None = 10_000
) -> DataFrame:
    """Newest calls with their release reason and rated prefix."""
    scope = panel_scope(records, flt, "event_time", ("entity", "origin_trunk", "sip_code"))
    return _newest(scope, limit).select(
        F.col("call_start_time").alias("start_time"),
        F.col("from_did").alias("ani"),
        F.col("to_did").alias("dnis"),
        dims.non_null("orig_trunk_group_name", "").alias("customer_trunk"),
        "sip_code",
        dims.release_reason().alias("release_reason"),
        dims.filled("orig_billed_prefix", dims.UNKNOWN).alias("billed_prefix"),
        dims.non_null("term_state", "").alias("state"),
        dims.non_null("term_ratecenter", "").alias("rate_center"),
        "entity", "callid",
    )


def routed_calls(
    records: DataFrame, flt: PanelFilter = PanelFilter(), limit: int | None = 1000
) -> DataFrame:
    """Newest calls that carry a media address, with route and quality."""
    scope = panel_scope(
        records, flt, "event_time", ("entity", "origin_trunk", "vendor", "trunk", "media_ip")
    ).where(F.col("term_media_ip") != "")
    return _newest(scope, limit).select(
        F.col("call_start_time").alias("call_started"),
        F.col("call_end_time").alias("call_ended"),
        "entity",
        dims.non_null("orig_trunk_group_name", "").alias("customer_trunk"),
        dims.non_null("orig_carrier_name", "").alias("customer_carrier"),
        dims.non_null("term_carrier_name", "").alias("vendor"),
        dims.non_null("term_trunk_group_name", "").alias("termination_trunk"),
        "term_ip", "term_media_ip", "from_did", "to_did", "sip_code",
        dims.outcome().alias("result"),
        dims.release_reason().alias("release_reason"),
        F.col("duration_real").alias("duration_sec"),
        F.col("orig_billed_duration").alias("billable_sec"),
        dims.non_null("stir_attest", "").alias("attestation"),
        F.round("mos_avg", 2).alias("mos"),
        "callid",
    )
