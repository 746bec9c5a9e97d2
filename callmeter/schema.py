"""Column contract of the call-record store."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _LONG, _DBL, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(),
)

# Column names and order of the stored record.
PROVENANCE = {
    "record_key": _LONG,
    "entity": _STR,
    "file_hour": _TS,
    "file_path": _STR,
    "source_size": _LONG,
    "source_mtime_ms": _LONG,
    "ingested_at": _TS,
    "event_time": _TS,
}
CALL = {
    "cdr_uuid": _STR,
    "callid": _STR,
    "call_start_time": _TS,
    "call_answered_time": _TS,
    "call_end_time": _TS,
    "from_did": _STR,
    "to_did": _STR,
    "lrn_did": _STR,
    "sip_code": _INT,
    "sip_reason": _STR,
    "reason": _STR,
    "duration_real": _LONG,
    "pdd": _LONG,
    "attempt_counter": _INT,
    "terminator": _STR,
    "leg": _STR,
    "direction": _STR,
}
ORIGINATION = {
    "orig_carrier_name": _STR,
    "orig_trunk_group_name": _STR,
    "orig_ip": _STR,
    "orig_media_ip": _STR,
    "orig_juris": _STR,
    "orig_rate": _DBL,
    "orig_billed_duration": _LONG,
    "orig_cost": _DBL,
    "orig_state": _STR,
    "orig_ratecenter": _STR,
    "orig_destination": _STR,
    "orig_billed_prefix": _STR,
}
TERMINATION = {
    "term_carrier_name": _STR,
    "term_trunk_group_name": _STR,
    "term_ip": _STR,
    "term_media_ip": _STR,
    "term_juris": _STR,
    "term_rate": _DBL,
    "term_billed_duration": _LONG,
    "term_cost": _DBL,
    "term_state": _STR,
    "term_ratecenter": _STR,
    "term_destination": _STR,
    "term_billed_prefix": _STR,
}
QUALITY = {
    "stir_x5u": _STR,
    "stir_attest": _STR,
    "mos_min": _DBL,
    "mos_avg": _DBL,
    "mos_max": _DBL,
}

# What a source file may carry; everything else in a file is ignored.
SOURCE_COLUMNS = {**CALL, **ORIGINATION, **TERMINATION, **QUALITY}
# ``bad_cells`` counts the cells of a row that did not parse.
RECORD_COLUMNS = {**PROVENANCE, **SOURCE_COLUMNS, "bad_cells": _INT}

# Columns without which a source file is refused.
REQUIRED_HEADERS = ("sip_code", "call_start_time", "call_end_time", "term_media_ip")

# Layout of every stored table: one partition per source hour.
PARTITIONS = ("entity", "file_date", "file_hh")

# Width of the unsigned source integers.
UINT_BITS = {
    "sip_code": 16,
    "duration_real": 32,
    "pdd": 32,
    "attempt_counter": 16,
    "orig_billed_duration": 32,
    "term_billed_duration": 32,
}


def record_schema() -> T.StructType:
    """Stored record, partition columns last (as Parquet partitioning returns them)."""
    body = [T.StructField(n, t) for n, t in RECORD_COLUMNS.items() if n != "entity"]
    tail = [
        T.StructField("entity", _STR),
        T.StructField("file_date", T.DateType()),
        T.StructField("file_hh", _INT),
    ]
    return T.StructType(body + tail)


# One line of the load log. ``seq`` orders lines written at the same instant.
MANIFEST_SCHEMA = T.StructType([
    T.StructField("file_path", _STR),
    T.StructField("entity", _STR),
    T.StructField("file_hour", _TS),
    T.StructField("source_size", _LONG),
    T.StructField("source_mtime_ms", _LONG),
    T.StructField("rows_ingested", _LONG),
    T.StructField("malformed_rows", _LONG),
    T.StructField("bad_cell_rows", _LONG),
    T.StructField("status", _STR),
    T.StructField("message", _STR),
    T.StructField("updated_at", _TS),
    T.StructField("seq", _INT),
])

AREA_CODE_SCHEMA = "npa string, state string"
WATCHLIST_SCHEMA = "termination_media_ip string"
