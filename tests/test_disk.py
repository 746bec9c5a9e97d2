"""What stays on the disks: shuffles of finished writes, loads and copies in bounded parts."""

import time
from datetime import datetime, timedelta

import pytest
from files import hour_file
from pyspark.sql import functions as F

from callmeter.plans import ingest
from callmeter.plans.ingest import IngestOptions
from callmeter.runtime import Folder, written, written_for
from callmeter.schema import PARTITIONS
from callmeter.sources import landing as src
from callmeter.sources import star_records as star
from callmeter.sources.commits import VersionedStore
from callmeter.sources.landing import Landing
from callmeter.sources.store import write_hours

NOW = datetime(2026, 7, 28, 6)
H0 = datetime(2026, 7, 28, 0)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffled(spark):
    """Shuffle files on this session's disks."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def left(spark, before):
    """Shuffle files since ``before``; they go soon after a query, not with it."""
    for _ in range(50):
        if not (more := shuffled(spark) - before):
            return more
        time.sleep(0.1)
    return more


@pytest.fixture()
def place(spark, interpreted, tmp_path):
    root = tmp_path / "landing"
    root.mkdir()
    return Landing(str(root), ("E0", "E1")), VersionedStore(spark, str(tmp_path / "store"))


def records(spark, hours):
    rows = spark.createDataFrame([(datetime(2024, 1, 2 + h // 24, h % 24, 7), f"c{h}") for h in hours], "event_time timestamp, callid string")
    fixed = {"entity": F.lit("E1"), "file_hour": F.date_trunc("hour", "event_time"), "call_end_time": F.col("event_time"), "call_start_time": F.col("event_time")}
    return rows.select(*[(fixed[n] if n in fixed else F.col(n) if n in rows.columns else (F.length("callid") + 7).cast("int")).alias(n) for n in star.RECORD])


def test_a_write_leaves_no_shuffle(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit("E0").alias("entity"), F.lit(H0.date()).alias("file_date"), F.lit(3).alias("file_hh"))
    before, dealt = shuffled(spark), rows.repartition(3, "id")
    assert len(written(dealt, "test").collect()) == 1000
    with written_for(dealt, "test") as held:
        assert len(held.collect()) == 1000
        files = held.inputFiles()
    assert files and not any(Folder(spark).exists(f) for f in files)
    write_hours(dealt, str(tmp_path / "hours"), ["id"])
    star.write_hour_files(records(spark, [1, 2]), str(tmp_path / "landing"))
    assert not left(spark, before) and spark.conf.get(CLEANUP, "false") == "false"


def test_a_table_is_copied_in_slices_of_whole_hours(place, spark, monkeypatch):
    landing, store = place
    for n, calls in enumerate((3, 1, 2, 5)):
        hour_file(landing.root, "E0", H0 + timedelta(hours=n), [{"callid": f"c{n}-{i}"} for i in range(calls)], age_from=NOW)
    hour_file(landing.root, "E1", H0, [{"callid": "z"}], age_from=NOW)
    ingest.ingest_cycle(store, landing, NOW)
    slices, put = [], VersionedStore._put

    def noted(to, table, rows):
        slices.append(sorted(r["callid"][:2] for r in rows.collect()))
        before = shuffled(spark)
        put(to, table, rows)
        assert not left(spark, before)

    monkeypatch.setattr(VersionedStore, "_put", noted)
    copy = VersionedStore(spark, f"{store.root}-copy")
    copy.copy_table("records", store, most_rows=4)
    assert slices == [["c0"] * 3 + ["z"], ["c1"] + ["c2"] * 2 + ["c3"] * 5]
    assert sorted(map(str, copy.records.collect())) == sorted(map(str, store.records.collect()))
    line = [*PARTITIONS, "rows", "first_event", "last_event"]
    assert sorted(copy.live("records").select(*line).collect()) == sorted(store.live("records").select(*line).collect())
    copy.copy_table("hits", store)
    assert copy.hits.count() == 0 and copy.records.count() == 12
    with copy.change() as to:
        to.copy_table("records", store)
        with pytest.raises(ValueError):
            to.copy_table("records", store)


def test_a_job_loads_a_bounded_number_of_bytes(place, spark, tmp_path):
    landing, store = place
    for n in range(4):
        hour_file(landing.root, "E0", H0 + timedelta(hours=n), [{"callid": f"c{n}"}], age_from=NOW)
    hour_file(landing.root, "E1", H0, [{"callid": "z"}], age_from=NOW)
    sizes = [r["source_size"] for r in src.discover(spark, landing, NOW).collect()]
    # An hour that is begun is loaded whole; the first one whatever its size.
    for most, turns in ((1, [1, 1, 1, 1, 1]), (sum(sizes[:2]) + 1, [3, 2]), (sum(sizes), [5])):
        done = ingest.backfill(VersionedStore(spark, str(tmp_path / f"store{most}")), landing, NOW, days=1, options=IngestOptions(min_age_seconds=0, max_bytes=most))
        assert [o.where("status = 'ingested'").count() for o in done] == turns
    assert VersionedStore(spark, str(tmp_path / "store1")).records.count() == 5
    files, cold = src.discover(spark, landing, NOW), str(tmp_path / "cold")

    def run():
        return ingest.write_cold_store(files, cold, NOW, max_bytes=sum(sizes[:2]) + 1).where("status = 'waiting'").count()

    assert [run(), run()] == [2, 0] and spark.read.parquet(f"{cold}/hours").count() == 5


def test_hour_files_are_the_same_in_slices(spark, tmp_path):
    given, hours = records(spark, [1, 4, 5, 5, 26, 29]), {}
    given = given.unionByName(given.where("callid = 'c1'").withColumn("file_hour", F.lit(None).cast("timestamp")))
    for slices in (1, 3):
        root = tmp_path / f"landing{slices}"
        star.write_hour_files(given, str(root), slices)
        files = list(root.rglob("part-*"))
        hours[slices] = {str(f.parent.relative_to(root)): [r["value"] for r in spark.read.text(str(f)).collect()] for f in files}
        assert len(files) == len(hours[slices])
    assert hours[1] == hours[3] and len(hours[1]) == 7
    assert [star.slices_of(n) for n in (0, star.SLICE_RECORDS, star.SLICE_RECORDS + 1)] == [1, 1, 2]
