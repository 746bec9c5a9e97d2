"""Loading hourly files: header contract, typing, state machine, replacement, retention."""

from datetime import datetime, timedelta

import pytest
from files import HEADER, ROW, hour_file
from pyspark.sql import functions as F

from callmeter.functions.predicates import source_hours
from callmeter.operators.coverage import missing_coverage
from callmeter.plans import ingest, rollups, watchlist
from callmeter.plans.ingest import IngestOptions, ingest_cycle
from callmeter.schema import PARTITIONS, WATCHLIST_SCHEMA
from callmeter.sources import landing as src
from callmeter.sources.landing import Landing
from callmeter.sources.manifest import load_problems
from callmeter.sources.store import CallStore

NOW = datetime(2026, 7, 28, 6)
H0 = datetime(2026, 7, 28, 0)


@pytest.fixture()
def place(spark, interpreted, tmp_path):
    root = tmp_path / "landing"
    root.mkdir()
    return Landing(str(root), ("E0", "E1")), CallStore(spark, str(tmp_path / "store"))


def statuses(outcome):
    return {r["file_path"].split("landing/")[1]: (r["status"], r["rows"]) for r in outcome.collect()}


def test_discovery_takes_only_stable_canonical_files(spark, place):
    landing, _ = place
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW)
    hour_file(landing.root, "E0", H0 + timedelta(hours=1), [{}], age_from=NOW, age_seconds=10)
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW, name="notes.csv.gz")
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW, name="24.csv.gz")
    hour_file(landing.root, "X9", H0, [{}], age_from=NOW)
    hour_file(landing.root + "/deep", "E0", H0, [{}], age_from=NOW)
    hour_file(landing.root, "E1", H0 - timedelta(days=3), [{}], age_from=NOW)
    found = src.discover(spark, landing, NOW).collect()
    assert [(r["entity"], r["file_hour"]) for r in found] == [("E0", H0)]


def test_cells_are_typed_by_name_and_bad_cells_kept(spark, place):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{"callid": "a", "orig_cost": "1.5"}], age_from=NOW, bom=True)
    permuted = list(reversed(HEADER)) + ["sip_reason", "Callid"]
    hour_file(
        landing.root, "E0", H0 + timedelta(hours=1),
        [{"callid": "b", "sip_code": "abc", "orig_cost": "x", "call_end_time": "", "call_start_time": "2026/07/28 01:02:03",
          "sip_reason": '"Busy, ""really"" Here"', "orig_billed_duration": "-5"}],
        header=permuted, age_from=NOW,
    )
    short = [h for h in HEADER if h != "orig_trunk_group_name"]
    hour_file(
        landing.root, "E1", H0, [{"callid": "c", "call_end_time": "", "call_start_time": "nonsense"}],
        header=short, raw_lines=["200,only,three"], age_from=NOW,
    )
    out = statuses(ingest_cycle(store, landing, NOW))
    assert set(out.values()) == {("ingested", 1)}
    rows = {r["callid"]: r for r in store.records.collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["orig_cost"] == 1.5 and rows["a"]["bad_cells"] == 0
    b = rows["b"]
    assert (b["sip_code"], b["orig_cost"], b["orig_billed_duration"]) == (0, 0.0, 0)
    assert b["event_time"] == datetime(2026, 7, 28, 1, 2, 3)
    assert b["sip_reason"] == 'Busy, "really" Here' and b["bad_cells"] == 3
    c = rows["c"]
    assert c["event_time"] == H0 and c["call_start_time"] is None
    assert c["orig_trunk_group_name"] is None
    log = {r["file_path"].split("landing/")[1]: r for r in store.manifest.latest.collect()}
    assert log["E1/2026/07/28/00.csv.gz"]["malformed_rows"] == 1
    assert log["E1/2026/07/28/00.csv.gz"]["bad_cell_rows"] == 1
    assert log["E0/2026/07/28/00.csv.gz"]["malformed_rows"] == 0


def test_broken_headers_are_refused_as_whole_files(place):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{}], header=[h for h in HEADER if h != "term_media_ip"], age_from=NOW)
    hour_file(landing.root, "E0", H0 + timedelta(hours=1), [{}], header=HEADER + ["callid"], age_from=NOW)
    hour_file(landing.root, "E0", H0 + timedelta(hours=2), [{}], header=HEADER + ["bad name"], age_from=NOW)
    hour_file(landing.root, "E1", H0, [{}], age_from=NOW)
    outcome = ingest_cycle(store, landing, NOW)
    assert sorted(s for s, _ in statuses(outcome).values()) == ["error", "error", "error", "ingested"]
    assert store.records.count() == 1
    messages = " | ".join(r["message"] for r in load_problems(store.manifest.latest).collect())
    assert "absent columns: 'term_media_ip'" in messages
    assert "repeated columns" in messages and "malformed columns" in messages
    summary = {r["status"]: r["files"] for r in ingest.cycle_summary(outcome).collect()}
    assert summary == {"error": 3, "ingested": 1}


def test_skip_then_replace_changed_hour_everywhere(place, spark):
    landing, store = place
    ingest.set_watchlist(store, spark.createDataFrame([("203.0.113.10",)], WATCHLIST_SCHEMA))
    hour_file(landing.root, "E0", H0, [{"callid": "a"}, {"callid": "b", "sip_code": "503"}], age_from=NOW)
    hour_file(landing.root, "E1", H0, [{"callid": "z"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    assert set(statuses(ingest_cycle(store, landing, NOW + timedelta(minutes=1))).values()) == {("skipped", 2), ("skipped", 1)}
    hour_file(landing.root, "E0", H0, [{"callid": "n", "term_media_ip": "192.0.2.1"}], age_from=NOW, age_seconds=1000)
    out = statuses(ingest_cycle(store, landing, NOW + timedelta(minutes=2)))
    assert out["E0/2026/07/28/00.csv.gz"] == ("ingested", 1)
    assert out["E1/2026/07/28/00.csv.gz"] == ("skipped", 1)
    assert {r["callid"] for r in store.records.collect()} == {"n", "z"}
    assert sum(r["attempts"] for r in store.media.collect()) == 2
    assert sum(r["attempts"] for r in store.reasons.collect()) == 2
    assert [(r["entity"], r["matching_cdrs"]) for r in store.hits.collect()] == [("E1", 1)]
    assert watchlist.alert_status(store.hits, store.watchlist).first()[0] == 1
    empty = spark.createDataFrame([], WATCHLIST_SCHEMA)
    ingest.set_watchlist(store, empty)
    assert watchlist.alert_status(store.hits, store.watchlist).first()[0] == -1


def test_failed_watchlist_leaves_list_and_hits(place, spark, monkeypatch):
    landing, store = place
    ingest.set_watchlist(store, spark.createDataFrame([("203.0.113.10",)], WATCHLIST_SCHEMA))
    hour_file(landing.root, "E0", H0, [{"callid": "a"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    ingest.set_watchlist(store, store.watchlist)  # its own list
    assert [r["matching_cdrs"] for r in store.hits.collect()] == [1]

    def fails(*_):
        raise RuntimeError("no hits today")

    monkeypatch.setattr(ingest, "watch_hits", fails)
    with pytest.raises(RuntimeError):
        ingest.set_watchlist(store, spark.createDataFrame([("192.0.2.1",)], WATCHLIST_SCHEMA))
    assert [r["termination_media_ip"] for r in store.watchlist.collect()] == ["203.0.113.10"]
    assert [r["matching_cdrs"] for r in store.hits.collect()] == [1]


def test_changed_file_is_flagged_and_left_alone(place):
    landing, store = place
    flag = IngestOptions(on_change="flag")
    hour_file(landing.root, "E0", H0, [{"callid": "a"}], age_from=NOW)
    ingest_cycle(store, landing, NOW, flag)
    hour_file(landing.root, "E0", H0, [{"callid": "b"}, {"callid": "c"}], age_from=NOW, age_seconds=900)
    again = [
        list(statuses(ingest_cycle(store, landing, NOW + timedelta(minutes=n), flag)).values())[0] for n in (1, 2)
    ]
    assert again == [("changed", 1), ("skipped", 1)]
    assert [r["callid"] for r in store.records.collect()] == ["a"]
    assert load_problems(store.manifest.latest).first()["status"] == "changed"
    # Switching to replacement loads what had only been flagged.
    out = list(statuses(ingest_cycle(store, landing, NOW + timedelta(minutes=3))).values())
    assert out == [("ingested", 2)]


def test_interrupted_load_is_recovered_or_redone(place, spark):
    landing, store = place
    path = hour_file(landing.root, "E0", H0, [{"callid": "a"}], age_from=NOW)
    hour_file(landing.root, "E1", H0, [{"callid": "b"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    lines = store.manifest.latest.where("status = 'done'").drop("status", "message")
    open_lines = lines.selectExpr("*", "'ingesting' AS status", "'' AS message")
    store.manifest.append(open_lines, NOW + timedelta(seconds=1), seq=1)
    store.drop_hours("records", [("E1", H0.date(), 0)])
    flag = IngestOptions(on_change="flag")
    out = statuses(ingest_cycle(store, landing, NOW + timedelta(seconds=2), flag))
    assert out["E0/2026/07/28/00.csv.gz"] == ("recovered", 1)
    assert out["E1/2026/07/28/00.csv.gz"] == ("ingested", 1)
    assert path.exists() and store.records.count() == 2
    assert {r["status"] for r in store.manifest.latest.collect()} == {"done"}


def test_emptied_hour_leaves_no_rows_behind(place):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{"callid": "a"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    hour_file(landing.root, "E0", H0, [], age_from=NOW, age_seconds=900)
    out = statuses(ingest_cycle(store, landing, NOW + timedelta(minutes=1)))
    assert list(out.values()) == [("ingested", 0)]
    assert store.records.count() == 0 and store.media.count() == 0


def test_cycles_take_the_oldest_files_first_until_done(place):
    landing, store = place
    for n in range(4):
        hour_file(landing.root, "E0", H0 + timedelta(hours=n), [{"callid": f"c{n}"}], age_from=NOW)
    outcomes = ingest.backfill(store, landing, NOW, days=1, options=IngestOptions(min_age_seconds=0, max_files=3))
    assert len(outcomes) == 2
    first = statuses(outcomes[0])
    assert [first[f"E0/2026/07/28/0{n}.csv.gz"][0] for n in range(4)] == ["ingested"] * 3 + ["waiting"]
    assert store.records.count() == 4


def test_coverage_by_hour_and_by_day(place, spark):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    hour_file(landing.root, "E1", H0, [{}], age_from=NOW)
    files = src.discover(spark, landing, NOW)
    day = H0.date()
    miss = missing_coverage(files, store.manifest.latest, ["E0", "E1"], day, day)
    assert [(r["entity"], r["file_hour"]) for r in miss.collect()] == [("E1", H0)]
    assert missing_coverage(files, store.manifest.latest, ["E0"], day, day).count() == 0
    hour_file(landing.root, "E0", H0, [{}, {}], age_from=NOW, age_seconds=900)
    files = src.discover(spark, landing, NOW)
    assert missing_coverage(files, store.manifest.latest, ["E0"], day, day).count() == 1
    archived = files.where("false")
    miss = missing_coverage(archived, store.manifest.latest, ["E0", "E1"], day, day).collect()
    assert [r["entity"] for r in miss] == ["E1"]


def test_retention_drops_whole_hours_and_log_lines(place, spark):
    landing, store = place
    old = H0 - timedelta(days=5)
    hour_file(landing.root, "E0", old, [{"call_end_time": "", "call_start_time": ""}], age_from=NOW)
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW)
    ingest.backfill(store, landing, NOW, days=10)
    assert store.stats().first()["total_rows"] == 2
    ingest.nightly(store, landing, NOW)
    stats = store.stats().first()
    assert (stats["total_rows"], stats["files_ingested"], stats["oldest_hour"]) == (1, 1, H0)
    assert store.media.count() == 1
    store.drop_before(H0 + timedelta(hours=1))
    assert store.records.count() == 0


def test_partition_pruning_reaches_the_scan(place):
    landing, store = place
    for n in (0, 5, 23):
        hour_file(landing.root, "E0", H0 - timedelta(days=1) + timedelta(hours=n), [{"callid": str(n)}], age_from=NOW)
    ingest.backfill(store, landing, NOW, days=2)
    day = H0.date() - timedelta(days=1)
    chosen = source_hours(store.records, ["E0", "ZZ"], day + timedelta(days=1), day, ["E0", "E1"], hours=(22, 5))
    assert {r["callid"] for r in chosen.collect()} == {"0", "5", "23"}
    narrow = source_hours(store.records, ["E0"], day, day, hours=(4, 6))
    assert [r["callid"] for r in narrow.collect()] == ["5"]
    plan = narrow._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "file_hh" in plan.split("PartitionFilters")[1].split("]")[0]


def test_cold_store_skips_present_hours(place, spark, tmp_path):
    import pyarrow.parquet as pq

    landing, _ = place
    hour_file(landing.root, "E0", H0, [{"callid": "a"}, {"callid": "b"}], age_from=NOW)
    cold = str(tmp_path / "cold")
    files = src.discover(spark, landing, NOW, 30)
    assert [r["status"] for r in ingest.write_cold_store(files, cold, NOW).collect()] == ["ok"]
    hour_file(landing.root, "E1", H0, [{"callid": "c"}], age_from=NOW)
    files = src.discover(spark, landing, NOW, 30)
    out = {r["entity"]: r["status"] for r in ingest.write_cold_store(files, cold, NOW).collect()}
    assert out == {"E0": "skip", "E1": "ok"}
    assert spark.read.parquet(cold + "/hours").count() == 3
    part = next((tmp_path / "cold" / "hours").rglob("part-*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"


def test_cold_store_goes_past_refused_files(place, spark, tmp_path):
    landing, _ = place
    for n in range(3):
        header = HEADER if n == 2 else [h for h in HEADER if h != "term_media_ip"]
        hour_file(landing.root, "E0", H0 + timedelta(hours=n), [{"callid": f"c{n}"}], header=header, age_from=NOW)
    cold, files = str(tmp_path / "cold"), src.discover(spark, landing, NOW, 30)

    def run():
        return [r["status"] for r in ingest.write_cold_store(files, cold, NOW, max_files=2).orderBy("file_hour").collect()]

    assert [run(), run(), run()] == [["error", "error", "waiting"], ["error", "error", "ok"], ["error", "error", "skip"]]


def test_older_files_read_null_for_new_columns(place, spark, tmp_path):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    older = CallStore(spark, str(tmp_path / "older"))
    store.records.drop("bad_cells", "pdd").write.partitionBy(*PARTITIONS).parquet(older.path("records"))
    older.replace_hours("records", store.records.withColumn("entity", F.lit("E1")))
    rows = {r["entity"]: r for r in older.records.collect()}
    assert rows["E0"]["callid"] == ROW["callid"] and rows["E0"]["pdd"] is None and rows["E1"]["pdd"] == 0


def test_views_serve_ad_hoc_sql(place, spark):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    store.register_views("cm_")
    row = spark.sql("SELECT count(*) n, max(callid) c FROM cm_records JOIN cm_manifest USING (file_path)").first()
    assert (row["n"], row["c"]) == (1, ROW["callid"])
    assert rollups.hour_counts(store.records).first()["rows"] == 1
