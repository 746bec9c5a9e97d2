"""Prepared results, exports and streams."""

import gzip
import time
from datetime import date, datetime, timedelta

import pytest
from files import hour_file
from pyspark.sql import functions as F

from callmeter.params import report_params
from callmeter.plans import snapshots
from callmeter.plans.ingest import IngestOptions
from callmeter.plans.reports import certificates_report, codes_report
from callmeter.plans.snapshots import SnapshotStore, due_snapshot_day, latest_complete_day
from callmeter.sources import sinks
from callmeter.sources.landing import HOUR_FOLDER, Landing
from callmeter.sources.star_records import FIRST_DAY, LAST_DAY, STAR_ENTITIES, star_records
from callmeter.sources.store import CallStore
from callmeter.streaming.arrivals import watch_landing
from callmeter.streaming import windows
from callmeter.streaming.windows import hourly_windows

SF = "/root/testdata/sf0.001"
TODAY = date(2026, 1, 10)


@pytest.mark.parametrize("start,end,tier", [
    (0, 0, "today"), (1, 1, "yesterday"), (2, 2, "recent"), (3, 3, "recent"), (4, 4, "historical"), (2, 0, "historical"),
])
def test_tiers(spark, start, end, tier):
    df = spark.createDataFrame([(TODAY - timedelta(days=start), TODAY - timedelta(days=end))], "s date, e date")
    assert df.select(snapshots.tier_of(F.col("s"), F.col("e"), F.lit(TODAY))).first()[0] == tier


def test_tier_without_a_start(spark):
    df = spark.sql("SELECT CAST(NULL AS DATE) s, CAST(NULL AS DATE) e")
    assert df.select(snapshots.tier_of(F.col("s"), F.col("e"), F.lit(TODAY))).first()[0] == "historical"


def test_snapshot_counts_once_it_is_final(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("A", 1.0)], "customer string, revenue double")
    params = {n: snapshots.daily_params(TODAY - timedelta(days=n), ("E0",)) for n in (1, 2)}
    store.put("customer-codes", params[2], rows, datetime(2026, 1, 9, 2), "r2")
    store.put("customer-codes", params[1], rows.union(rows), datetime(2026, 1, 10, 1), "r1")
    newest = latest_complete_day(store.index, "customer-codes", TODAY)
    assert newest.first()["end_date"] == date(2026, 1, 8)
    store.put("customer-codes", params[1], rows.union(rows), datetime(2026, 1, 10, 2), "r1b")
    newest = latest_complete_day(store.index, "customer-codes", TODAY)
    assert newest.first()["end_date"] == date(2026, 1, 9) and store.index.count() == 2
    assert store.rows(newest, "customer-codes").count() == 2
    assert latest_complete_day(store.index, "other", TODAY).count() == 0
    fresh = snapshots.with_freshness(store.index, datetime(2026, 1, 10, 2, 20)).collect()
    assert {(r["tier"], r["age_seconds"], r["stale"]) for r in fresh} == {("yesterday", 1200, True), ("yesterday", 87600, True)}
    assert len(store.roll(date(2026, 1, 13))) == 2 and store.index.count() == 1


def test_served_results_are_computed_once(spark, tmp_path):
    store, calls = SnapshotStore(spark, str(tmp_path)), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("A", float(len(calls)))], "customer string, revenue double")

    params = snapshots.daily_params(TODAY, ("E0",))
    at = datetime(2026, 1, 10, 12)
    first, _ = store.serve("r", params, compute, at, "a")
    again, line = store.serve("r", params, compute, at + timedelta(minutes=6), "b")
    assert len(calls) == 1 and first.first()["revenue"] == again.first()["revenue"] == 1.0
    assert (line.first()["tier"], line.first()["stale"]) == ("today", True)
    renewed, line = store.serve("r", params, compute, at + timedelta(minutes=7), "c", force=True)
    assert renewed.first()["revenue"] == 2.0 and not line.first()["stale"]


def test_due_day_waits_for_the_final_hour():
    assert due_snapshot_day(datetime(2026, 1, 10, 1, 59)) == date(2026, 1, 8)
    assert due_snapshot_day(datetime(2026, 1, 10, 2)) == date(2026, 1, 9)


def test_capped_export(spark, tmp_path):
    params = report_params(FIRST_DAY, STAR_ENTITIES, end_date=LAST_DAY)
    records = star_records(spark, SF)
    report = codes_report(records, params)
    gap = spark.createDataFrame([("E0", FIRST_DAY)], "entity string, day date")
    with pytest.raises(sinks.ExportRefused):
        sinks.write_capped_csv(report.rows, str(tmp_path / "a"), sinks.CODE_EXPORT_COLUMNS, missing=gap)
    with pytest.raises(sinks.ExportRefused):
        sinks.write_capped_csv(report.rows, str(tmp_path / "b"), sinks.CODE_EXPORT_COLUMNS, gap.limit(0), cap=3)
    with pytest.raises(sinks.ExportRefused):  # nothing to write, but incomplete
        sinks.write_capped_csv(report.rows.where("attempts < 0"), str(tmp_path / "d"), sinks.CODE_EXPORT_COLUMNS, gap)
    n = report.rows.count()
    assert sinks.complete_only(report.rows, gap.limit(0), cap=n).count() == n
    sinks.write_capped_csv(
        certificates_report(records, params).rows, str(tmp_path / "c"), sinks.CERTIFICATE_EXPORT_COLUMNS
    )
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert tuple(back.columns) == sinks.CERTIFICATE_EXPORT_COLUMNS and back.count() > 0


def test_sum_over_entities_is_the_whole(spark):
    records = star_records(spark, SF)

    def attempts(entities):
        return codes_report(records, report_params(FIRST_DAY, STAR_ENTITIES, end_date=LAST_DAY, entities=entities)).totals.first()["attempts"]

    assert sum(attempts([e]) for e in STAR_ENTITIES) == attempts(None)


def test_stream_waits_for_young_files_and_survives_restart(spark, interpreted, tmp_path):
    (tmp_path / "landing").mkdir()
    landing = Landing(str(tmp_path / "landing"), ("E0",))
    store = CallStore(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 28, 6)
    options = IngestOptions(lookback_days=None)

    def drain(at):
        watch_landing(store, landing, str(tmp_path / "cp"), options, once=True, clock=lambda: at).awaitTermination()
        return {r["callid"] for r in store.records.collect()}

    hour_file(landing.root, "E0", datetime(2026, 7, 28, 0), [{"callid": "old"}], age_from=now)
    hour_file(landing.root, "E0", datetime(2026, 7, 28, 1), [{"callid": "young"}], age_from=now, age_seconds=5)
    assert drain(now) == {"old"}
    assert drain(now) == {"old"}
    hour_file(landing.root, "E0", datetime(2026, 7, 28, 2), [{"callid": "next"}], age_from=now + timedelta(hours=1))
    assert drain(now + timedelta(hours=1)) == {"old", "young", "next"}


def test_running_stream_loads_young_file_without_another_arrival(spark, interpreted, tmp_path):
    landing = Landing(str(tmp_path / "landing"), ("E0",))
    store = CallStore(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 28, 6)
    clock = {"now": now}
    hour_file(landing.root, "E0", datetime(2026, 7, 28, 1), [{"callid": "young"}], age_from=now, age_seconds=5)
    stream = watch_landing(
        store, landing, str(tmp_path / "cp"), IngestOptions(lookback_days=None), interval="1 second", clock=lambda: clock["now"],
    )

    def until(reached):
        end = time.monotonic() + 60
        while not reached() and time.monotonic() < end and stream.isActive:
            time.sleep(0.2)
        assert reached(), stream.exception()

    try:
        until(lambda: store.manifest.latest.where("status = 'waiting'").count() == 1)
        assert store.records.count() == 0
        clock["now"] = now + timedelta(hours=1)
        until(lambda: store.manifest.latest.where("status = 'done'").count() == 1)
    finally:
        stream.stop()
    assert [r["callid"] for r in store.records.collect()] == ["young"]


def test_hour_in_parts_survives_small_batches(spark, interpreted, tmp_path):
    root, now, hour = str(tmp_path / "landing"), datetime(2026, 7, 28, 6), datetime(2026, 7, 28, 0)
    folder = "entity=E0/y=2026/m=07/d=28/h=00"
    for n in range(3):
        made = hour_file(str(tmp_path / "made"), "E0", hour, [{"callid": f"p{n}"}], age_from=now)
        part = tmp_path / "landing" / folder / f"part-{n}.csv.gz"
        part.parent.mkdir(parents=True, exist_ok=True)
        part.write_bytes(made.read_bytes())
    store = CallStore(spark, str(tmp_path / "store"))
    watch_landing(
        store, Landing(root, ("E0",), HOUR_FOLDER), str(tmp_path / "cp"), IngestOptions(lookback_days=None),
        once=True, files_per_batch=1, clock=lambda: datetime(2100, 1, 1),
    ).awaitTermination()
    assert {r["callid"] for r in store.records.collect()} == {"p0", "p1", "p2"}
    assert sum(r["attempts"] for r in store.media.collect()) == 3


def test_more_files_than_one_job_takes_all_arrive(spark, interpreted, tmp_path):
    landing, now = Landing(str(tmp_path / "landing"), ("E0",)), datetime(2026, 7, 28, 12)
    for n in range(4):
        hour_file(landing.root, "E0", datetime(2026, 7, 28, n), [{"callid": f"c{n}"}], age_from=now)
    refused = tmp_path / "landing/E0/2026/07/28/00.csv.gz"
    refused.write_bytes(gzip.compress(b"nothing\n1\n"))
    store = CallStore(spark, str(tmp_path / "store"))
    options = IngestOptions(lookback_days=None, max_files=1)
    watch_landing(store, landing, str(tmp_path / "cp"), options, once=True, clock=lambda: datetime(2100, 1, 1)).awaitTermination()
    assert {r["callid"] for r in store.records.collect()} == {"c1", "c2", "c3"}
    assert {r["status"] for r in store.manifest.latest.collect()} == {"done", "error"}


def test_append_mode_holds_back_the_open_windows(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parque[t]")
    hourly = hourly_windows(stream, "ts", ["event_type"], {"n": F.count(F.lit(1))}, delay="1 hour")
    out = str(tmp_path / "out")
    (
        hourly.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out).awaitTermination()
    )
    closed, batch = spark.read.parquet(out).count(), (
        spark.read.parquet(f"{SF}/events.parquet").select(F.date_trunc("hour", "ts"), "event_type").distinct().count()
    )
    assert 0 < closed < batch


def test_exact_windows_count_late_rows(spark, tmp_path):
    path, state, arrivals = (str(tmp_path / n) for n in ("windows", "state", "arrivals"))
    deliveries = (["10:05", "12:30"], ["10:59", "11:01", "12:59"], ["09:00", "13:10"])
    for n, times in enumerate(deliveries):
        rows = spark.createDataFrame([(datetime.fromisoformat(f"2026-01-05 {t}"), "a") for t in times], "ts timestamp, k string")
        rows.coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(rows.schema).parquet(arrivals)
        windows.exact_windows(stream, "ts", ["k"], {"n": F.count(F.lit(1))}, path, state).awaitTermination()
    summed = windows.summed_windows(spark, path, ["k"], ["n"]).collect()
    # 12:30 is the newest event before the second delivery: 10:59 is late by the hour, 11:01 is not; before the third it is 12:59.
    assert {r["hour"].hour: (r["n"], r["late_rows"]) for r in summed} == {9: (1, 1), 10: (2, 1), 11: (1, 0), 12: (2, 0), 13: (1, 0)}
    side = windows.late_arrivals(spark, path, ["k"]).collect()
    assert sorted((r["batch_id"], r["hour"].hour, r["late_rows"]) for r in side) == [(1, 10, 1), (2, 9, 1)]


def test_hot_set_is_served_by_request(spark, tmp_path):
    store, at = SnapshotStore(spark, str(tmp_path)), datetime(2024, 1, 20, 12)
    day = date(2024, 1, 20)
    records = star_records(spark, SF)
    snapshots.store_hot_set(records, store, "codes", day, STAR_ENTITIES, at, "run", limit=20)
    assert store.index.count() == 30
    params = report_params(day - timedelta(days=2), STAR_ENTITIES, end_date=day, entities=["E2"], limit=20)
    rows, entry = store.serve("codes", params, lambda: pytest.fail("computed again"), at, "run2")
    wanted = codes_report(records, params).rows
    assert sorted(map(str, rows.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect())) and rows.count() == 20
    assert entry.first()["tier"] == "historical" and entry.count() == 1
