"""Small hourly source files for tests."""

from __future__ import annotations

import gzip
import os
from datetime import datetime, timezone
from pathlib import Path

HEADER = [
    "sip_code", "call_start_time", "call_end_time", "term_media_ip", "term_ip", "term_carrier_name",
    "term_trunk_group_name", "orig_trunk_group_name", "orig_billed_duration", "orig_cost", "term_cost",
    "callid", "to_did",
]
ROW = {
    "sip_code": "200", "call_start_time": "2026-07-28 00:00:01", "call_end_time": "2026-07-28 00:01:01",
    "term_media_ip": "203.0.113.10", "term_ip": "198.51.100.20", "term_carrier_name": "Vendor A",
    "term_trunk_group_name": "Vendor-A-TG", "orig_trunk_group_name": "Customer A",
    "orig_billed_duration": "60", "orig_cost": "0.01", "term_cost": "0.005", "callid": "call-1",
    "to_did": "12025550123",
}


def hour_file(
    root, entity: str, hour: datetime, rows, header=HEADER, bom: bool = False, raw_lines=(), age_from: datetime | None = None,
    age_seconds: int = 3600, name: str | None = None,
) -> Path:
    """Write one ``entity/YYYY/MM/DD/HH.csv.gz`` and set its modification time."""
    path = Path(root) / entity / f"{hour:%Y}" / f"{hour:%m}" / f"{hour:%d}" / (name or f"{hour:%H}.csv.gz")
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join(header)]
    lines += [",".join(str({**ROW, **r}.get(h, "")) for h in header) for r in rows]
    lines += list(raw_lines)
    text = ("﻿" if bom else "") + "\n".join(lines) + "\n"
    with gzip.open(path, "wb") as out:
        out.write(text.encode("utf-8"))
    if age_from is not None:
        stamp = age_from.replace(tzinfo=timezone.utc).timestamp() - age_seconds
        os.utime(path, (stamp, stamp))
    return path
