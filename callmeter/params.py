"""Report parameters and their validation, plus the named presets."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, fields, replace
from datetime import date, datetime, timedelta

MAX_QUERY_DAYS = 31  # default bound on the days of a request
# Raised whenever the shape or meaning of report rows changes.
KEY_VERSION = 4

# Accepted sort fields and quick filters.
SORT_FIELDS = (
    "customer", "code", "term_code", "state", "ratecenter", "x5u_url", "attest",
    "attempts", "completions", "asr_pct", "minutes", "revenue", "cost", "margin",
)
STATE_SORT_FIELDS = (
    "customer", "state", "attempts", "completions", "asr_pct",
    "minutes", "revenue", "cost", "margin",
)
QUICK_FILTERS = ("fas-suspect", "profitable")
# Release reasons of a 503 that users pick from.
KNOWN_REASONS = (
    "NO_VENDOR_RATE", "NO_CUSTOMER_RATE", "LIMITS_EXCEEDED", "ROUTES_EXHAUSTED",
    "CARRIER_REJECT", "EX_ROUTING_BLOCK", "EMPTY_TG_LIST", "LOOP_BLOCKED",
    "SPAM_FILTER", "CALL_FAILURE",
)
_REASON = re.compile(r"[A-Z0-9_]{1,40}")


class InvalidParams(ValueError):
    """A request outside the accepted ranges."""


def _day(value) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else datetime.strptime(str(value), "%Y-%m-%d").date()


def _unique(values) -> tuple:
    return tuple(dict.fromkeys(values))


def clean_reasons(values) -> tuple[str, ...]:
    """Upper-cased, trimmed reason tokens; anything else is left out."""
    tokens = (str(v).strip().upper() for v in values or ())
    return _unique(t for t in tokens if _REASON.fullmatch(t))


@dataclass(frozen=True)
class ReportParams:
    """One report request. Build it with :func:`report_params`."""

    start_date: date
    end_date: date
    entities: tuple[str, ...]
    sip_codes: tuple[int, ...] = ()
    reasons: tuple[str, ...] = ()
    customer: str | None = None
    start_hour: int | None = None
    end_hour: int | None = None
    limit: int | None = None
    sort_by: str = "revenue"
    sort_dir: str = "desc"
    quick_filter: str | None = None
    state_side: str = "orig"

    @property
    def hour_filter(self) -> tuple[int, int] | None:
        """The hour window, or None when it spans the whole day anyway."""
        if self.start_hour is None or (self.start_hour, self.end_hour) == (0, 23):
            return None
        return self.start_hour, self.end_hour

    def key(self, report: str) -> str:
        """Canonical request key: equal requests agree whatever their list order."""
        body = {k: (str(v) if isinstance(v, date) else v) for k, v in asdict(self).items()}
        for name in ("entities", "sip_codes", "reasons"):
            body[name] = sorted(body[name])
        body.update(report=report, version=KEY_VERSION)
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()


def _listed(value, one) -> tuple:
    if isinstance(value, str) or not isinstance(value, (list, tuple)):
        raise TypeError
    return _unique(one(v) for v in value)


def _between(low: int, high: int):
    def read(value) -> int:
        number = int(value)
        if not low <= number <= high:
            raise ValueError
        return number

    return read


def _one_of(allowed):
    def read(value) -> str:
        if value not in allowed:
            raise ValueError
        return value

    return read


def _short_text(value) -> str | None:
    text = str(value).strip()
    if len(text) > 255:
        raise ValueError
    return text or None


# Field, how its value is read, and what it has to be; a missing value keeps the field's default.
_RULES = (
    ("start_date", _day, "a day such as 2026-01-05"),
    ("end_date", _day, "a day such as 2026-01-05"),
    ("sip_codes", lambda v: _listed(v, _between(100, 699)), "a list of response codes 100-699"),
    ("customer", _short_text, "at most 255 characters"),
    ("start_hour", _between(0, 23), "an hour 0-23"),
    ("end_hour", _between(0, 23), "an hour 0-23"),
    ("limit", lambda v: max(1, int(v)), "a number of rows"),
    ("sort_by", _one_of(SORT_FIELDS), "a known sort field"),
    ("sort_dir", lambda v: _one_of(("asc", "desc"))(v.lower()), "asc or desc"),
    ("quick_filter", _one_of(QUICK_FILTERS), "a known filter"),
)


def report_params(start_date, known_entities, *, max_days: int | None = MAX_QUERY_DAYS, **given) -> ReportParams:
    """Validate a request against the entities this deployment knows; every fault is named at once.

    ``given`` holds the other fields of :class:`ReportParams`. Without a ``limit``
    a report returns all its rows; ``max_days=None`` lifts the bound on the date range.
    """
    unknown = set(given) - {f.name for f in fields(ReportParams)}
    if unknown:
        raise TypeError(f"no such parameter: {sorted(unknown)}")
    given["start_date"] = start_date
    faults, read = [], {}
    for name, reader, meaning in _RULES:
        if given.get(name) in (None, "") and name != "start_date":
            continue
        try:
            read[name] = reader(given[name])
        except (TypeError, ValueError, AttributeError):
            faults.append(f"{name}: expected {meaning}, got {given[name]!r}")

    chosen = given.get("entities")
    try:
        read["entities"] = _listed(tuple(known_entities) if chosen is None else chosen, _one_of(tuple(known_entities)))
    except (TypeError, ValueError):
        faults.append(f"entities: expected some of {list(known_entities)}, got {chosen!r}")
    else:
        if not read["entities"]:
            faults.append("entities: the list is empty")

    if "start_date" in read:
        span = (read.setdefault("end_date", read["start_date"]) - read["start_date"]).days + 1
        if span < 1 or max_days is not None and span > max_days:
            faults.append(f"end_date: the request covers {span} days" + (f" of at most {max_days}" if max_days else ""))
    if ("start_hour" in read) != ("end_hour" in read):
        faults.append("start_hour, end_hour: one without the other")
    if faults:
        raise InvalidParams("; ".join(faults))

    side = str(given.get("state_side") or "").lower()
    return ReportParams(**read, reasons=clean_reasons(given.get("reasons")), state_side="term" if side == "term" else "orig")


# Date presets: (days back of the first day, days back of the last day).
_DATE_PRESETS = {
    "today": (0, 0),
    "yesterday": (1, 1),
    "last3": (2, 0),
    "last7": (6, 0),
    "last30": (29, 0),
}
HOUR_PRESETS = {
    "all": None,
    "peak-us": (14, 22),
    "business": (9, 17),
    "overnight": (22, 6),
}
_TABLE_PRESETS = {
    "worst-margin": ("margin", "asc", None),
    "top-revenue": ("revenue", "desc", None),
    "top-traffic": ("attempts", "desc", None),
    "fas-suspect": ("attempts", "desc", "fas-suspect"),
    "profitable": ("margin", "desc", "profitable"),
    "clear": ("revenue", "desc", None),
}


def date_preset(name: str, today: date) -> tuple[date, date]:
    """First and last day of a named window ending at ``today`` (UTC)."""
    back_first, back_last = _DATE_PRESETS[name]
    return today - timedelta(days=back_first), today - timedelta(days=back_last)


def with_hour_preset(params: ReportParams, name: str) -> ReportParams:
    """Set a named hour window."""
    first, last = HOUR_PRESETS[name] or (None, None)
    return replace(params, start_hour=first, end_hour=last)


def with_table_preset(params: ReportParams, name: str) -> ReportParams:
    """Apply a named sort and filter.

    The failing-route preset also lifts the outcome filter: an answer rate needs
    the failures in its denominator.
    """
    sort_by, sort_dir, quick = _TABLE_PRESETS[name]
    changed = replace(params, sort_by=sort_by, sort_dir=sort_dir, quick_filter=quick)
    return replace(changed, sip_codes=()) if name == "fas-suspect" else changed


def with_reasons(params: ReportParams, reasons) -> ReportParams:
    """Attach reasons, which only mean something when 503 is in scope."""
    in_scope = not params.sip_codes or 503 in params.sip_codes
    return replace(params, reasons=clean_reasons(reasons) if in_scope else ())


@dataclass(frozen=True)
class PanelFilter:
    """Time range (both ends included) and optional equalities of a dashboard panel."""

    start: datetime | None = None
    end: datetime | None = None
    entity: str | None = None
    origin_trunk: str | None = None
    vendor: str | None = None
    trunk: str | None = None
    media_ip: str | None = None
    sip_code: int | None = None
