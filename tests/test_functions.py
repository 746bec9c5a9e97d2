"""Metric, dimension, predicate and parsing rules on hand-made rows."""

import ipaddress
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from callmeter.functions import dims, metrics, network, predicates
from callmeter.functions.network import parse_addresses
from callmeter.functions.parsing import best_effort_float, best_effort_timestamp, best_effort_uint
from callmeter.operators.topk import ordering, top_rows, top_rows_per_group
from callmeter.operators.versions import latest_version
from callmeter.params import PanelFilter, report_params
from callmeter.plans import reports, rollups, watchlist

RECORD = (
    "entity string, file_hour timestamp, call_end_time timestamp, event_time timestamp, to_did string, sip_code int, "
    "sip_reason string, reason string, orig_trunk_group_name string, orig_billed_prefix string, orig_state string, "
    "orig_billed_duration long, orig_cost double, term_cost double, term_state string, term_ratecenter string, "
    "term_billed_prefix string, stir_x5u string, stir_attest string"
)
T0 = datetime(2026, 1, 5, 10, 30)


def record(**kw):
    base = dict(
        entity="E0", file_hour=datetime(2026, 1, 5, 10), call_end_time=T0, event_time=T0, to_did="12025550100",
        sip_code=200, sip_reason="", reason="", orig_trunk_group_name="T", orig_billed_prefix="1201555",
        orig_state="CA", orig_billed_duration=60, orig_cost=0.01, term_cost=0.005, term_state="NJ",
        term_ratecenter="RC", term_billed_prefix="1212", stir_x5u="u", stir_attest="A",
    )
    return tuple({**base, **kw}.values())


@pytest.fixture()
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RECORD)


P = report_params("2026-01-05", ("E0", "E1"))


def one(df):
    return df.collect()[0].asDict()


def test_metric_block(frame):
    df = frame(record(), record(sip_code=503, orig_cost=0.00004, term_cost=0.1), record(sip_code=404, orig_billed_duration=7))
    row = one(df.agg(*metrics.partial_metrics()).select(*metrics.finished_metrics()))
    assert row == {
        "attempts": 3, "completions": 1, "asr_pct": 33.33, "minutes": 1.0,
        "revenue": 0.02, "cost": 0.11, "margin": -0.09,
    }


def test_minutes_are_null_without_an_answer(frame):
    row = one(frame(record(sip_code=503)).agg(*metrics.partial_metrics()).select(*metrics.finished_metrics()))
    assert row["minutes"] is None and row["asr_pct"] == 0.0


def test_no_rows_give_null_ratio(frame):
    row = one(frame().agg(*metrics.partial_metrics()).select(*metrics.finished_metrics()))
    assert row["attempts"] == 0 and row["asr_pct"] is None and row["revenue"] is None
    totals = one(reports.codes_report(frame(), P).totals)
    assert totals["code_count"] == 0 and totals["attempts"] == 0 and totals["asr_pct"] == 0.0 and totals["revenue"] == 0.0


def test_money_rounds_half_away_from_zero(spark):
    units = spark.createDataFrame([(5000,), (4999,), (-5000,), (-4999,), (15000,)], "u long")
    assert [r[0] for r in units.select(metrics.money_steps(F.col("u"))).collect()] == [1, 0, -1, 0, 2]


def test_margin_rounds_the_difference(frame):
    # 0.00006 - 0.00014: the rounded amounts differ by 0, the rounded difference is -0.0001.
    row = one(frame(record(orig_cost=0.00006, term_cost=0.00014)).agg(*metrics.partial_metrics()).select(*metrics.finished_metrics()))
    assert (row["revenue"], row["cost"], row["margin"]) == (0.0001, 0.0001, -0.0001)


def test_scope_keeps_us_numbers_in_period(frame):
    df = frame(
        record(), record(to_did="442025550100"), record(to_did="1202555010"), record(to_did=None),
        record(file_hour=datetime(2026, 1, 6)), record(file_hour=datetime(2026, 1, 4, 23)), record(entity="E9"),
    )
    assert predicates.report_scope(df, P).count() == 1


@pytest.mark.parametrize("window,hours", [
    ((9, 17), {9, 10, 17}), ((22, 6), {0, 6, 22, 23}), ((10, 10), {10}), ((0, 23), {0, 6, 9, 10, 17, 22, 23, 7}),
])
def test_hour_windows(frame, window, hours):
    df = frame(*[record(call_end_time=datetime(2026, 1, 5, h)) for h in (0, 6, 7, 9, 10, 17, 22, 23)])
    params = report_params("2026-01-05", ("E0",), start_hour=window[0], end_hour=window[1])
    kept = predicates.report_scope(df, params).select(F.hour("call_end_time")).collect()
    assert {r[0] for r in kept} == hours


def test_dimension_words(frame):
    df = frame(record(
        orig_trunk_group_name=None, orig_billed_prefix="  ", term_billed_prefix=None, term_state=None,
        term_ratecenter="", stir_x5u="", stir_attest=None,
    ))
    row = one(reports.customer_codes_report(df, P).rows)
    assert (row["customer"], row["code"], row["term_code"], row["state"], row["ratecenter"]) == (
        "(none)", "(unrated)", "(unrated)", "?", "",
    )
    assert (row["x5u_url"], row["attest"]) == ("(unsigned)", "?")
    assert one(reports.customer_codes_report(frame(record(orig_trunk_group_name="")), P).rows)["customer"] == ""


def test_prefix_is_kept_whole(frame):
    df = frame(record(orig_billed_prefix=" 1201555 "), record(orig_billed_prefix="1201"))
    assert {r["code"] for r in reports.codes_report(df, P).rows.collect()} == {"1201555", "1201"}


def test_codes_report_ignores_sort_and_filter(frame):
    df = frame(record(), record(orig_billed_prefix="1999", orig_cost=5.0, term_cost=9.0))
    params = report_params("2026-01-05", ("E0",), sort_by="attempts", sort_dir="asc", quick_filter="profitable")
    assert [r["code"] for r in reports.codes_report(df, params).rows.collect()] == ["1999", "1201555"]


def test_totals_ignore_filter_and_limit(frame):
    df = frame(record(), record(orig_trunk_group_name="U", orig_cost=0.0, term_cost=1.0))
    params = report_params("2026-01-05", ("E0",), quick_filter="profitable", limit=1)
    report = reports.customer_codes_report(df, params).stored()
    assert report.rows.count() == 1 and one(report.rows_with_count)["filtered_row_count"] == 1
    totals = one(report.totals)
    assert (totals["pair_count"], totals["customer_count"], totals["margin"]) == (2, 2, -0.995)
    assert one(reports.customer_array(report))["customers"] == ["T", "U"]
    with pytest.raises(ValueError):
        reports.customer_array(report, bound=1)


def test_fas_filter_needs_volume(frame):
    few = [record(orig_trunk_group_name="few", sip_code=503)] * 49
    many = [record(orig_trunk_group_name="many", sip_code=503)] * 50
    params = report_params("2026-01-05", ("E0",), quick_filter="fas-suspect")
    assert [r["customer"] for r in reports.customer_codes_report(frame(*few, *many), params).rows.collect()] == ["many"]


def test_sort_puts_nulls_last_both_ways(frame):
    df = frame(record(), record(orig_trunk_group_name="A", sip_code=503))
    for direction in ("asc", "desc"):
        params = report_params("2026-01-05", ("E0",), sort_by="minutes", sort_dir=direction)
        assert reports.customer_codes_report(df, params).rows.collect()[-1]["minutes"] is None


def test_state_of_rated_prefix(frame, spark):
    codes = spark.createDataFrame([("201", "NJ"), ("2012", "XX"), ("abc", "YY")], "npa string, state string")
    rows = [
        ("1201555", "CA", "NJ"), ("201", "CA", "NJ"), ("1999555", " TX ", "TX"), ("999", "tfree", "?"),
        (None, "", "?"), ("", "CA", "CA"), ("1120155", "CA", "CA"),
    ]
    df = frame(*[record(orig_billed_prefix=p, orig_state=s, orig_trunk_group_name=str(i)) for i, (p, s, _) in enumerate(rows)])
    got = {r["customer"]: r["state"] for r in reports.customer_state_report(df, P, codes).rows.collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(rows)}


def test_customers_ignore_outcome_filters(frame):
    df = frame(record(sip_code=503), record(orig_trunk_group_name=""), record(orig_trunk_group_name=None), record(orig_trunk_group_name="B"))
    params = report_params("2026-01-05", ("E0",), sip_codes=[200], customer="nobody")
    assert [r["name"] for r in reports.customers(df, params).collect()] == ["B", "T"]


def test_search(spark):
    df = spark.createDataFrame([("A1", None), ("b", "xA1y"), ("c", "d")], "code string, customer string")
    assert reports.search_rows(df, " a1 ").count() == 2
    assert reports.search_rows(df, "").count() == 3


def test_flags(spark):
    df = spark.createDataFrame([(-1.0, 10.0, 2.0), (1.0, 40.0, 4.0), (None, None, 0.0)], "margin double, asr_pct double, revenue double")
    rows = metrics.with_margin_pct(metrics.with_row_flags(df)).collect()
    assert [(r["margin_flag"], r["asr_flag"], r["margin_pct"]) for r in rows] == [
        ("loss", "warn", -50.0), ("gain", "good", 25.0), ("even", "warn", None),
    ]


def test_release_reason(frame):
    df = frame(record(reason="R", sip_reason="S"), record(sip_reason="S"), record(sip_reason=None, reason=None))
    assert [r[0] for r in df.select(dims.release_reason()).collect()] == ["R", "S", "Not provided"]


@pytest.mark.parametrize("text,want", [
    ("2026-07-28 00:00:01", datetime(2026, 7, 28, 0, 0, 1)), ("2026-07-28T00:00:01Z", datetime(2026, 7, 28, 0, 0, 1)),
    ("2026-07-28T02:00:01+02:00", datetime(2026, 7, 28, 0, 0, 1)), ("2026/07/28 01:02:03", datetime(2026, 7, 28, 1, 2, 3)),
    ("2026/07/28", datetime(2026, 7, 28)), ("1785196801", datetime(2026, 7, 28, 0, 0, 1)),
    ("1785196801000", datetime(2026, 7, 28, 0, 0, 1)), ("20260728000001", datetime(2026, 7, 28, 0, 0, 1)),
    ("07/28/2026 00:00:01", datetime(2026, 7, 28, 0, 0, 1)), ("28 Jul 2026 00:00:01", datetime(2026, 7, 28, 0, 0, 1)),
    ("Tue, 28 Jul 2026 00:00:01", datetime(2026, 7, 28, 0, 0, 1)), ("", None), ("nonsense", None), ("2026", None),
])
def test_timestamps(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(best_effort_timestamp(F.col("t"))).first()[0] == want


def test_numbers(spark):
    cells = ["7", "0", "-1", "1.9", "", "abc", "65535", "65536", "99999999999999999999"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    assert [r[0] for r in df.select(best_effort_uint(F.col("t"), 16)).collect()] == [7, 0, None, None, None, None, 65535, None, None]
    assert [r[0] for r in df.limit(6).select(best_effort_float(F.col("t"))).collect()] == [7.0, 0.0, -1.0, 1.9, None, None]


def test_watchlist_text(spark):
    text = "203.0.113.10, 2001:0db8::1;203.0.113.10\n198.51.100.20 70.36. \n"
    valid, rejects = parse_addresses(spark.createDataFrame([(text,)], "line string"), "line")
    assert {r[0] for r in valid.collect()} == {"203.0.113.10", "2001:db8::1", "198.51.100.20"}
    assert [r[0] for r in rejects.collect()] == ["70.36."]


def test_other_spellings_of_watched_addresses(spark):
    traffic = spark.createDataFrame([(" 2001:0db8::1",), ("2001:db8:0::2",), ("203.0.113.10",)], "term_media_ip string")
    watch = spark.createDataFrame([("2001:db8::1",), ("203.0.113.10",)], "termination_media_ip string")
    got = {(r[0], r[1]) for r in watchlist.spelled_out(traffic, watch).collect()}
    assert got == {("2001:db8::1",) * 2, ("203.0.113.10",) * 2, ("2001:0db8::1", "2001:db8::1")}
    assert watchlist.watched_only(traffic, watch).count() == 1
    assert watchlist.watched_only(traffic, watch, any_spelling=True).count() == 2


def test_addresses_agree_with_the_standard_library(spark, interpreted):
    """Canonical text of many spellings, valid and not, as ``ipaddress`` has it; no Python runs in the plan."""
    rng = random.Random(2)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", ":::", "1:::2", "::1::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::",
             "::1.2.3.4", "::ffff:1.2.3.4", "::FFFF:0102:0304", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::01.2.3.4", "1.2.3.4::", "fe80::1%eth0",
             "fe80::A%", "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "", " ", "name", "0:0:1:0:0:0:1:0", "1:0:0:2:0:0:3:4", "0:0:0:0:0:0:0:0", "0:1:0:1:0:1:0:1", "00::", "::ffff:0:0"]
    for _ in range(300):
        groups = [rng.choice(["0", "0", "00", "0000", "1", "Ab", "0f0", "ffff"]) for _ in range(rng.choice([8, 8, 8, 7, 9, 5]))]
        text = ":".join(groups)
        if rng.random() < 0.5:
            cut = sorted(rng.sample(range(len(groups) + 1), 2))
            text = ":".join(groups[: cut[0]]) + "::" + ":".join(groups[cut[1] :])
        texts.append(text)

    def expected(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", network.canonical_ip("t"))
    assert {r["t"]: r["c"] for r in df.collect()} == {t: expected(t) for t in texts}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_gap_rows_of_the_reason_grid(spark):
    rows = [
        ("A", "NJ", "1", 200, "OK", 5), ("A", "NJ", "1", 503, "X", 3), ("B", "TX", "", 200, "OK", 9), ("B", "", "1", 200, "OK", 1),
        ("(none)", "CA", "1", 200, "OK", 4),
    ]
    rollup = spark.createDataFrame(
        [(date(2026, 1, 5), datetime(2026, 1, 5, 1), "E0", *r) for r in rows],
        "day date, hour timestamp, entity string, orig_trunk_group_name string, term_state string, billed_prefix string, "
        "sip_code int, reason string, attempts long",
    )
    grid = [tuple(r) for r in rollups.reason_grid(rollup).collect()]
    assert grid == [
        ("B", "TX", "—", "200 - OK", 9, 100.0), ("A", "NJ", "1", "200 - OK", 5, 62.5), ("A", "NJ", "1", "503 - X", 3, 37.5),
        ("A", "CA", "—", "(no traffic)", 0, 0.0), ("A", "TX", "—", "(no traffic)", 0, 0.0),
        ("B", "CA", "—", "(no traffic)", 0, 0.0), ("B", "NJ", "—", "(no traffic)", 0, 0.0),
    ]
    assert [tuple(r) for r in rollups.reason_grid(rollup, limit=None).collect()] == grid
    only_a = rollups.reason_grid(rollup, PanelFilter(origin_trunk="A"))
    assert {(r["customer"], r["state"]) for r in only_a.collect()} == {("A", "NJ"), ("A", "CA"), ("A", "TX")}


def test_rollup_words(frame):
    df = frame(record(reason=None, term_state="", orig_trunk_group_name=""))
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("term_media_ip", "term_ip", "term_carrier_name", "term_trunk_group_name")})
    df = df.withColumns({"pdd": F.lit(0), "mos_avg": F.lit(0.0)})
    row = one(rollups.merged_media(rollups.media_rollup(df)))
    assert row["term_media_ip"] == row["reason"] == row["orig_trunk_group_name"] == "(none)"
    assert (row["term_state"], row["stir_attest"], row["pdd_count"], row["mos_count"], row["mos_sum"]) == ("?", "A", 0, 0, 0.0)


def test_latest_version_and_top_rows(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), ("b", 1, 7)], "k string, v int, x int")
    assert {tuple(r) for r in latest_version(df, ["k"], ["v"]).collect()} == {("a", 2, 5), ("b", 1, 7)}
    assert top_rows(df, ordering("x", "desc", ["k", "v"]), 1).first()["x"] == 10


def test_top_rows_per_group_with_one_hot_group(spark):
    """A group with most of the rows gives the same answer as a plain window."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("g"),
        "id", ((F.col("id") * 7919) % 1009).alias("x"),
    )
    order = ordering("x", "desc", ["id"])
    got = top_rows_per_group(df, ["g"], order, 25, spread_by=["id"])
    local = {}
    for r in df.collect():
        local.setdefault(r["g"], []).append((-r["x"], r["id"]))
    want = {(g, i) for g, rows in local.items() for _, i in sorted(rows)[:25]}
    assert {(r["g"], r["id"]) for r in got.collect()} == want


@pytest.mark.parametrize("any_spelling", [False, True])
def test_a_short_watchlist_goes_below_the_rollup(spark, capsys, any_spelling):
    calls = spark.createDataFrame([("2001:DB8::1 ", 1), ("2001:db8:0::1", 2), ("203.0.113.9", 3), ("", 4), (None, 5), ("x", 6)], "term_media_ip string, n int")
    watch = spark.createDataFrame([("2001:db8::1",), ("203.0.113.9",), (None,), ("",)], "termination_media_ip string")
    rollup = calls.groupBy("term_media_ip").agg(F.sum("n").alias("n"))
    watched = watchlist.watched_only(rollup, watch, any_spelling=any_spelling)
    assert sorted(r["n"] for r in watched.collect()) == ([1, 2, 3, 4] if any_spelling else [3, 4])
    watched.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines()
    assert next(i for i, line in enumerate(plan) if "Aggregate [term_media_ip" in line) < next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)


def test_a_long_watchlist_is_not_broadcast(spark, monkeypatch):
    calls = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "term_media_ip string, n int")
    watch = spark.createDataFrame([("a",), ("b",)], "termination_media_ip string")
    for most in (1, 2):
        monkeypatch.setattr(watchlist, "MOST_BROADCAST", most)
        watched = watchlist.watched_only(calls, watch)
        assert watched.count() == 2 and ("rightHint=(strategy=broadcast)" in watched._jdf.queryExecution().optimizedPlan().toString()) == (most == 2)
