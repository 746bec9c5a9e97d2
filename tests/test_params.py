"""Request validation, presets and keys."""

from dataclasses import replace
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from callmeter.params import (
    InvalidParams, clean_reasons, date_preset, report_params,
    with_hour_preset, with_reasons, with_table_preset,
)

E = ("E0", "E1", "E2", "E3")


def ok(**kw):
    return report_params(kw.pop("start_date", "2026-01-05"), E, **kw)


def test_defaults():
    p = ok()
    assert (p.start_date, p.end_date) == (date(2026, 1, 5),) * 2
    assert p.entities == E and p.limit is None
    assert (p.sort_by, p.sort_dir, p.quick_filter, p.state_side) == ("revenue", "desc", None, "orig")


@pytest.mark.parametrize("bad", [
    {"start_date": None}, {"start_date": "05/01/2026"}, {"end_date": "2026-01-04"}, {"end_date": "2026-02-05"},
    {"entities": []}, {"entities": ["E9"]}, {"entities": "E0"}, {"sip_codes": [999]}, {"sip_codes": ["x"]},
    {"sip_codes": "200"}, {"start_hour": 3}, {"end_hour": 3}, {"start_hour": 0, "end_hour": 24},
    {"start_hour": "a", "end_hour": 2}, {"limit": "many"}, {"sort_by": "callid"}, {"sort_dir": "up"},
    {"quick_filter": "odd"}, {"customer": "x" * 256},
])
def test_rejections(bad):
    with pytest.raises(InvalidParams):
        ok(**bad)


def test_longest_range_and_limits():
    assert ok(end_date="2026-02-04").end_date == date(2026, 2, 4)
    assert ok(end_date="2027-02-04", max_days=None).end_date == date(2027, 2, 4)
    assert ok(limit=0).limit == 1 and ok(limit=10**9).limit == 10**9


def test_all_faults_are_named():
    with pytest.raises(InvalidParams, match="sip_codes.*limit.*sort_by.*entities"):
        ok(sip_codes=["x"], limit="many", sort_by="callid", entities=["E9"])


def test_cleaning():
    p = ok(entities=["E1", "E0", "E1"], sip_codes=["503", 200, 503], customer="  T ", reasons=[" call_failure", "no way", "CALL_FAILURE"])
    assert p.entities == ("E1", "E0") and p.sip_codes == (503, 200)
    assert p.customer == "T" and p.reasons == ("CALL_FAILURE",)
    assert ok(customer="  ").customer is None and ok(state_side="sideways").state_side == "orig"
    assert clean_reasons(None) == ()


def test_full_day_window_is_no_filter():
    assert ok(start_hour=0, end_hour=23).hour_filter is None
    assert ok(start_hour=22, end_hour=6).hour_filter == (22, 6)


def test_presets():
    today = date(2026, 3, 2)
    assert date_preset("today", today) == (today, today)
    assert date_preset("yesterday", today) == (date(2026, 3, 1),) * 2
    assert date_preset("last3", today) == (date(2026, 2, 28), today)
    assert date_preset("last7", today)[0] == date(2026, 2, 24)
    assert date_preset("last30", today)[0] == date(2026, 2, 1)
    assert with_hour_preset(ok(), "peak-us").hour_filter == (14, 22)
    assert with_hour_preset(ok(start_hour=1, end_hour=2), "all").hour_filter is None
    p = with_table_preset(ok(sip_codes=[200]), "fas-suspect")
    assert p.sip_codes == () and (p.sort_by, p.quick_filter) == ("attempts", "fas-suspect")
    assert with_table_preset(ok(sip_codes=[200]), "worst-margin").sip_codes == (200,)
    assert with_table_preset(p, "clear").quick_filter is None


def test_reasons_need_503_in_scope():
    assert with_reasons(ok(sip_codes=[200]), ["CALL_FAILURE"]).reasons == ()
    assert with_reasons(ok(sip_codes=[503]), ["CALL_FAILURE"]).reasons == ("CALL_FAILURE",)
    assert with_reasons(ok(), ["CALL_FAILURE"]).reasons == ("CALL_FAILURE",)


@given(st.permutations(E), st.permutations([200, 404, 503]))
def test_key_ignores_list_order(entities, codes):
    assert ok(entities=entities, sip_codes=codes).key("r") == ok(sip_codes=[200, 404, 503]).key("r")


def test_key_tells_requests_apart():
    base = ok()
    keys = {base.key("r"), base.key("s"), *(
        replace(base, **c).key("r") for c in (
            {"state_side": "term"}, {"limit": 5}, {"customer": "T"}, {"sort_dir": "asc"}, {"reasons": ("A",)},
        )
    )}
    assert len(keys) == 7
