"""Row predicates of the reports and panels.

Every predicate is a plain column expression, so Catalyst pushes it to the scan
and the ones on partition columns prune folders.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.params import PanelFilter, ReportParams


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def us_destination() -> Column:
    """Dialled number is ``1`` plus ten digits."""
    return F.col("to_did").startswith("1") & (F.length("to_did") == 11)


def _midnight(day: date) -> Column:
    return F.lit(datetime(day.year, day.month, day.day).isoformat(" ")).cast("timestamp")


def hour_of_day(col: str, window: tuple[int, int]) -> Column:
    """Hour window, both ends included; a window like 22–6 wraps over midnight."""
    first, last = window
    hour = F.hour(col)
    if first <= last:
        return hour.between(first, last)
    return (hour >= first) | (hour <= last)


def in_period(columns: list[str], first: date, last: date) -> Column:
    """Half-open range on the source hour, and on its date partition if there is one."""
    conditions = [
        F.col("file_hour") >= _midnight(first),
        F.col("file_hour") < _midnight(last + timedelta(days=1)),
    ]
    if "file_date" in columns:
        conditions.append(F.col("file_date").between(F.lit(first), F.lit(last)))
    return all_of(conditions)


def report_scope(records: DataFrame, params: ReportParams) -> DataFrame:
    """Records a report request covers."""
    conditions = [
        F.col("entity").isin(*params.entities),
        in_period(records.columns, params.start_date, params.end_date),
        us_destination(),
    ]
    if params.sip_codes:
        conditions.append(F.col("sip_code").isin(*params.sip_codes))
    if params.reasons:
        conditions.append(F.col("reason").isin(*params.reasons))
    if params.customer:
        conditions.append(F.col("orig_trunk_group_name") == params.customer)
    if params.hour_filter:
        conditions.append(hour_of_day("call_end_time", params.hour_filter))
    return records.where(all_of(conditions))


def source_hours(
    records: DataFrame, entities, first: date, last: date, known_entities=None, hours=None
) -> DataFrame:
    """Prune to the source partitions of entities × days × hours.

    Reversed dates are swapped, unknown entities skipped, days without files
    simply hold no partition; an hour window may wrap.
    """
    first, last = min(first, last), max(first, last)
    known = set(known_entities if known_entities is not None else entities)
    conditions = [
        F.col("entity").isin(*[e for e in entities if e in known]),
        F.col("file_date").between(F.lit(first), F.lit(last)),
    ]
    if hours is not None and all(0 <= h <= 23 for h in hours):
        start, end = hours
        hh = F.col("file_hh")
        conditions.append(hh.between(start, end) if start <= end else (hh >= start) | (hh <= end))
    return records.where(all_of(conditions))


def quick_filter(name: str | None) -> Column | None:
    """Conditions on finished groups (HAVING)."""
    if name == "fas-suspect":
        return (F.col("asr_pct") < 15) & (F.col("attempts") >= 50)
    if name == "profitable":
        return F.col("margin") > 0
    return None


def search(text: str | None, columns: list[str]) -> Column:
    """Case-insensitive substring over any of ``columns``."""
    needle = (text or "").strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle) for c in columns]
    return reduce(or_, hits)


_PANEL_COLUMNS = {
    "entity": "entity",
    "origin_trunk": "orig_trunk_group_name",
    "vendor": "term_carrier_name",
    "trunk": "term_trunk_group_name",
    "media_ip": "term_media_ip",
    "sip_code": "sip_code",
}


def panel_scope(
    table: DataFrame, flt: PanelFilter, time_column: str, only: tuple[str, ...] = tuple(_PANEL_COLUMNS)
) -> DataFrame:
    """Apply the time range and the chosen equalities; unset ones are no-ops.

    Where the table has a ``day`` column the range is repeated on it, since
    Spark cannot derive that from the hour.
    """
    conditions: list[Column] = []
    for bound, compare in ((flt.start, "__ge__"), (flt.end, "__le__")):
        if bound is not None:
            conditions.append(getattr(F.col(time_column), compare)(F.lit(bound.isoformat(" ")).cast("timestamp")))
            if "day" in table.columns:
                conditions.append(getattr(F.col("day"), compare)(F.lit(bound.date())))
    for name in only:
        value = getattr(flt, name)
        if value is not None:
            conditions.append(F.col(_PANEL_COLUMNS[name]) == value)
    return table.where(all_of(conditions))
