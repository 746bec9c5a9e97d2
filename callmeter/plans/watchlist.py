"""Matching media addresses against a watchlist, and the alert panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.functions import dims
from callmeter.functions.network import one_spelling
from callmeter.operators.topk import top_rows
from callmeter.params import PanelFilter
from callmeter.schema import PARTITIONS

HIT_KEYS = [
    "hour", "termination_media_ip", "entity", "orig_trunk_group_name",
    "term_carrier_name", "term_trunk_group_name", "term_ip",
]
# Addresses of some 60 bytes each.
MOST_BROADCAST = 1_000_000
_MATCH_KEYS = [k for k in HIT_KEYS if k != "hour"]


def spelled_out(traffic: DataFrame, watchlist: DataFrame, column: str = "term_media_ip") -> DataFrame:
    """The watchlist plus every other spelling of its addresses found in traffic."""
    texts = traffic.select(F.trim(column).alias("spelling")).distinct()
    alias = texts.withColumn("termination_media_ip", one_spelling(F.col("spelling"))).join(watchlist, "termination_media_ip", "left_semi")
    plain = watchlist.select(F.col("termination_media_ip").alias("spelling"), "termination_media_ip")
    return plain.unionByName(alias.select("spelling", "termination_media_ip")).distinct()


def watched_only(
    traffic: DataFrame, watchlist: DataFrame, column: str = "term_media_ip", any_spelling: bool = False
) -> DataFrame:
    """Rows whose trimmed media address is on the list.

    With ``any_spelling`` both sides are compared by the canonical text of the address, so other
    spellings of a listed version-6 address count too. A list known to be short is broadcast: the optimizer
    then takes it below the rollup and the joins under it, so that only watched calls are shuffled and summed.
    """
    spelled = one_spelling if any_spelling else F.trim
    listed = watchlist.select(spelled(F.col("termination_media_ip")).alias("termination_media_ip")).distinct()
    if listed.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        listed = F.broadcast(listed)
    # An absent address is on no list. Said of the column itself: the optimizer would else ask it of the spelled address, and spell each twice.
    known = traffic.where(F.col(column).isNotNull())
    return known.withColumn("termination_media_ip", F.coalesce(spelled(F.col(column)), F.lit(""))).join(listed, "termination_media_ip", "left_semi")


def watch_hits(media_rollup: DataFrame, watchlist: DataFrame, any_spelling: bool = True) -> DataFrame:
    """Matching calls per hour and route, from the media rollup.

    On a stored rollup the source partition stays a key, so a reloaded source
    hour replaces exactly its own hits.
    """
    source = [p for p in PARTITIONS if p in media_rollup.columns and p != "entity"]
    return (
        watched_only(media_rollup, watchlist, any_spelling=any_spelling)
        .groupBy(*HIT_KEYS, *source)
        .agg(F.sum("attempts").alias("matching_cdrs"))
    )


def alert_status(hits: DataFrame, watchlist: DataFrame) -> DataFrame:
    """-1 without a watchlist, else the number of addresses seen."""
    configured = watchlist.agg(F.count(F.lit(1))).scalar()
    seen = hits.agg(F.count_distinct("termination_media_ip").alias("seen"))
    return seen.select(
        F.when(configured == 0, F.lit(-1)).otherwise(F.col("seen")).cast("long").alias("watched_ip_status")
    )


def watched_matches(hits: DataFrame, limit: int | None = 500) -> DataFrame:
    """Matched routes, most recently seen first."""
    routes = hits.groupBy(*_MATCH_KEYS).agg(
        F.min("hour").alias("first_seen"),
        F.max("hour").alias("last_seen"),
        F.sum("matching_cdrs").alias("matching_cdrs"),
    )
    return top_rows(routes, [F.desc("last_seen"), *[F.asc(k) for k in _MATCH_KEYS]], limit)


def watched_records(
    records: DataFrame, hits: DataFrame, watchlist: DataFrame,
    flt: PanelFilter = PanelFilter(), limit: int | None = 1000,
) -> DataFrame:
    """Single calls to watched addresses in the day that ends with the latest hit hour."""
    latest = hits.agg(F.max("hour")).scalar()
    in_window = (F.col("event_time") >= latest - F.expr("INTERVAL 24 HOURS")) & (
        F.col("event_time") < latest + F.expr("INTERVAL 1 HOUR")
    )
    chosen = watched_only(records.where(in_window), watchlist, any_spelling=True)
    if flt.media_ip is not None:
        chosen = chosen.where(F.col("termination_media_ip") == flt.media_ip)
    order = [F.desc("event_time"), F.asc("callid"), F.asc("call_start_time")]
    return top_rows(chosen, order, limit).select(
        F.col("call_start_time").alias("call_started"),
        F.col("call_end_time").alias("call_ended"),
        "entity",
        dims.non_null("orig_trunk_group_name", "").alias("customer_trunk"),
        dims.non_null("term_trunk_group_name", "").alias("termination_trunk"),
        "term_ip", "termination_media_ip", "from_did", "to_did", "sip_code",
        dims.outcome().alias("result"),
        dims.release_reason().alias("release_reason"),
        "callid",
    )
