"""The versioned store: changes as a whole, pinned readers, zone maps, watchlist changes, retention; one scan over many headers."""

import random
from datetime import datetime, timedelta

import pytest
from files import HEADER, hour_file
from pyspark.sql import functions as F

from callmeter.plans import ingest, rollups
from callmeter.plans.ingest import ingest_cycle
from callmeter.plans.watchlist import watch_hits
from callmeter.schema import WATCHLIST_SCHEMA
from callmeter.sources import landing as src
from callmeter.sources.commits import CommitTaken, VersionedStore
from callmeter.sources.landing import Landing

NOW = datetime(2026, 7, 28, 6)
H0 = datetime(2026, 7, 28, 0)
TABLES = ("records", "media", "reasons", "hits")


@pytest.fixture()
def place(spark, interpreted, tmp_path):
    root = tmp_path / "landing"
    root.mkdir()
    return Landing(str(root), ("E0", "E1")), VersionedStore(spark, str(tmp_path / "store"))


def addresses(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], WATCHLIST_SCHEMA)


def counts(store):
    return [store.read(t).count() for t in TABLES]


def test_replacement_is_seen_as_a_whole(place, spark, monkeypatch):
    landing, store = place
    ingest.set_watchlist(store, addresses(spark, "203.0.113.10"))
    hour_file(landing.root, "E0", H0, [{"callid": "a"}, {"callid": "b", "sip_code": "503"}], age_from=NOW)
    hour_file(landing.root, "E1", H0, [{"callid": "z"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    assert counts(store) == [3, 3, 3, 2]
    before, reading = store.pinned(), store.records
    hour_file(landing.root, "E0", H0, [{"callid": "n", "term_media_ip": "192.0.2.1"}], age_from=NOW, age_seconds=900)

    def fails(_):
        raise RuntimeError("between two tables")

    with monkeypatch.context() as broken:
        broken.setattr(rollups, "reason_rollup", fails)
        with pytest.raises(RuntimeError):
            ingest_cycle(store, landing, NOW + timedelta(minutes=1))
    assert counts(store) == counts(before) == [3, 3, 3, 2]
    # The load log has no finished line, so the next cycle does it again.
    ingest_cycle(store, landing, NOW + timedelta(minutes=2))
    assert counts(store) == [2, 2, 2, 1] and counts(before) == [3, 3, 3, 2]
    assert {r["callid"] for r in store.records.collect()} == {"n", "z"}
    assert {r["callid"] for r in reading.collect()} == {"a", "b", "z"}
    removed = store.vacuum()
    assert len(removed) >= 4 and counts(store) == [2, 2, 2, 1]
    hour_file(landing.root, "E0", H0, [], age_from=NOW, age_seconds=800)
    ingest_cycle(store, landing, NOW + timedelta(minutes=3))
    assert counts(store) == [1, 1, 1, 1]


def test_two_changes_from_one_commit(place, spark):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{"callid": "a"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    records = store.records
    with pytest.raises(CommitTaken), store.change() as slow:
        slow.replace_hours("records", records.where("false"))
        slow.drop_hours("records", [("E0", H0.date(), 0)])
        with store.change() as quick:
            quick.replace_hours("records", records.unionAll(records))
    assert store.records.count() == 2
    with pytest.raises(ValueError, match="twice"), store.change() as to:
        to.replace_hours("records", records)
        to.replace_hours("records", records)


def test_event_hours_open_few_folders(place, spark):
    landing, store = place
    for n in range(5):
        late = {"call_end_time": f"2026-07-28 0{n}:59:59", "callid": f"c{n}"}
        early = {"call_end_time": f"2026-07-28 0{max(0, n - 1)}:59:59", "callid": f"e{n}"}
        hour_file(landing.root, "E0", H0 + timedelta(hours=n), [late, early], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    zones = {r["file_hh"]: (r["first_event"].hour, r["last_event"].hour, r["rows"]) for r in store.live("records").collect()}
    assert zones == {n: (max(0, n - 1), n, 2) for n in range(5)}
    chosen = store.read_events("records", H0 + timedelta(hours=2), H0 + timedelta(hours=2))
    assert sorted(r["callid"] for r in chosen.collect()) == ["c2", "e3"]
    plan = chosen._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters")[1].split("]")[0]
    assert "file_date" in filters and "version" in filters and "dynamicpruning" in plan
    assert "file_hh" in plan.split("PushedFilters")[1].split("]")[0]
    assert sorted(r["callid"] for r in store.read_hours("records", [("E0", H0.date(), 2), ("E0", H0.date(), 3)]).collect()) == ["c2", "c3", "e2", "e3"]
    assert store.read_events("media", H0 + timedelta(hours=9)).count() == 0


def test_watchlist_change_equals_a_rebuild(place, spark):
    landing, store = place
    ingest.set_watchlist(store, addresses(spark, "203.0.113.10", "203.0.113.11"))
    for n, seen in enumerate((["203.0.113.10"], ["203.0.113.11", "203.0.113.12"], ["203.0.113.10", " 203.0.113.11"], ["203.0.113.12"], ["203.0.113.11"])):
        hour_file(landing.root, "E0", H0 + timedelta(hours=n), [{"term_media_ip": ip, "callid": ip} for ip in seen], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    old = {r["file_hh"]: r["version"] for r in store.live("hits").collect()}
    ingest.change_watchlist(store, addresses(spark, "203.0.113.12", "203.0.113.11"), addresses(spark, "203.0.113.10", "192.0.2.9"))
    assert {r[0] for r in store.watchlist.collect()} == {"203.0.113.11", "203.0.113.12"}
    full = watch_hits(store.media, store.watchlist)
    assert sorted(map(str, store.hits.select(*full.columns).collect())) == sorted(map(str, full.collect())) and full.count() == 5
    new = {r["file_hh"]: r["version"] for r in store.live("hits").collect()}
    assert set(old) == {0, 1, 2, 4} and set(new) == {1, 2, 3, 4}
    assert new[4] == old[4] and new[2] > old[2]  # an hour without a change keeps its files


def test_retention_is_one_commit(place, spark):
    landing, store = place
    hour_file(landing.root, "E0", H0 - timedelta(days=5), [{}], age_from=NOW)
    hour_file(landing.root, "E0", H0, [{}], age_from=NOW)
    ingest.backfill(store, landing, NOW, days=10)
    before = store.head()
    assert store.records.count() == 2 and len(store.drop_before(H0)) > 0
    assert store.records.count() == store.media.count() == 1 and store.head() == before + 1
    store.drop_before(H0 + timedelta(hours=1))
    assert store.records.count() == 0 and store.records.columns == store.pinned().read("records").columns


def test_many_headers_are_one_scan(place, spark):
    landing, store = place
    rng = random.Random(4)
    for n in range(20):
        header = rng.sample(HEADER, len(HEADER))
        header = [h for h in header if n % 3 or h != "term_cost"] + [f"x{i}" for i in range(n % 4)]
        rows = [{"callid": f"c{n}", "term_cost": str(n), "orig_trunk_group_name": '"A, ""B"""', **{f"x{i}": "9" for i in range(4)}}, {"callid": "", "term_cost": ""}]
        hour_file(landing.root, "E0", H0 - timedelta(hours=n), rows, header=header, raw_lines=["1,2", ",".join(["7"] * 30)], age_from=NOW, bom=n % 2 == 0)
    files = src.with_headers(src.discover(spark, landing, NOW, 2))
    cells = src.read_cells(spark, files)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    rows = cells.collect()
    assert len(rows) == 80 and sum(r["malformed"] for r in rows) == 40
    good = {r["callid"]: r for r in rows if not r["malformed"] and r["callid"]}
    assert len(good) == 20 and all(good[f"c{n}"]["term_cost"] == ("" if n % 3 == 0 else str(n)) for n in range(20))
    assert {r["orig_trunk_group_name"] for r in good.values()} == {'A, "B"'} and {r["sip_code"] for r in good.values()} == {"200"}


def test_files_of_one_width_with_much_text_are_scanned_by_themselves(place, spark, monkeypatch):
    landing, store = place
    for n in range(6):
        header = HEADER + [f"x{i}" for i in range(n % 3)]
        rows = [{"callid": f"c{n}", "orig_trunk_group_name": '"A, ""B"""', **{f"x{i}": "9" for i in range(2)}}, {"callid": ""}]
        hour_file(landing.root, "E0", H0 - timedelta(hours=n), rows, header=header, raw_lines=["1,2", ",".join(["7"] * 14)] if n < 4 else [], age_from=NOW)
    files = src.with_headers(src.discover(spark, landing, NOW, 2))
    together = sorted(src.read_cells(spark, files).collect())
    for least, most, scans in ((1, 16, 3), (1, 1, 2)):
        monkeypatch.setattr(src, "OWN_SCAN_BYTES", least)
        monkeypatch.setattr(src, "MOST_SCANS", most)
        cells = src.read_cells(spark, files)
        assert cells._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == scans
        assert sorted(cells.collect()) == together


def test_only_files_with_broken_lines_are_read_again(place, spark, monkeypatch):
    landing, store = place
    for n in range(4):
        hour_file(landing.root, "E0", H0 - timedelta(hours=n), [{"callid": f"c{n}"}], raw_lines=["1,2"] if n == 2 else [], age_from=NOW)
    read, read_cells = [], src.read_cells
    monkeypatch.setattr(src, "read_cells", lambda spark, files: read.append(files.count()) or read_cells(spark, files))
    ingest.backfill(store, landing, NOW, days=2)
    assert read == [4, 1]
    assert sorted(r["malformed_rows"] for r in store.manifest.latest.collect()) == [0, 0, 0, 1]


def test_hours_of_a_folder_share_their_files(place, spark):
    store = place[1]
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(H0.isoformat(" ")).cast("timestamp")) - F.col("id") * 3600)
    schema = store.read("hits").schema
    rows = spark.range(240).select("id", at.alias("hour"), F.lit("E0").alias("entity"), F.to_date(at).alias("file_date"), F.hour(at).alias("file_hh"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.replace_hours("hits", rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = store.hits.inputFiles()
    assert store.hits.count() == 240 and len(files) <= 2 * store.hits.select("file_date").distinct().count()


def test_a_change_counts_what_it_wrote_once(place, spark):
    landing, store = place
    hour_file(landing.root, "E0", H0, [{"callid": "a"}, {"callid": "b"}], age_from=NOW)
    hour_file(landing.root, "E1", H0 + timedelta(hours=2), [{"callid": "z"}], age_from=NOW)
    ingest_cycle(store, landing, NOW)
    copy = VersionedStore(spark, f"{store.root}-copy")
    with copy.change() as to:
        to.replace_hours("records", store.records)
        lines = to._written("records")
        assert "FileScan" not in lines._jdf.queryExecution().executedPlan().toString()
    zone = F.date_trunc("hour", "event_time")
    want = store.records.groupBy("entity", "file_date", "file_hh").agg(F.count("*"), F.min(zone), F.max(zone)).collect()
    got = copy.live("records").select("entity", "file_date", "file_hh", "rows", "first_event", "last_event").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
