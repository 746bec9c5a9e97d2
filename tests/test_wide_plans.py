"""Wide projections: what is worked out once, and in methods of what size."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callmeter.functions.parsing import best_effort_float, best_effort_timestamp
from callmeter.plans import ingest
from callmeter.runtime import small_methods
from callmeter.sources import landing as src
from callmeter.sources import star_records as star
from callmeter.sources.commits import VersionedStore

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def _records(spark, hours):
    rows = spark.createDataFrame([(datetime(2024, 1, 2, h, 7), f"c{h}") for h in hours], "event_time timestamp, callid string")
    fixed = {"entity": F.lit("E1"), "file_hour": F.date_trunc("hour", "event_time"), "call_end_time": F.col("event_time"), "call_start_time": F.col("event_time")}
    return rows.select(*[(fixed[n] if n in fixed else F.col(n) if n in rows.columns else (F.length("callid") + 7).cast("int")).alias(n) for n in star.RECORD])


def test_cells_are_worked_out_before_their_order_is_looked_up(spark, capsys):
    star.hour_lines(_records(spark, [1, 5])).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    looked_up = [line for line in plan.splitlines() if "transform(" in line]
    assert looked_up and not any("length(" in line for line in looked_up)


def test_hour_files_have_their_header_their_cells_and_their_broken_line(spark, tmp_path):
    root = str(tmp_path / "landing")
    star.write_hour_files(_records(spark, [1, 4, 5, 5]), root)
    headers = star.hour_headers()
    for hour, rows in ((1, 1), (4, 1), (5, 2)):
        lines = [r["value"] for r in spark.read.text(f"{root}/entity=E1/y=2024/m=01/d=02/h={hour:02d}").collect()]
        cell = {"callid": f"c{hour}", "x_trace": "?"} | {n: f"2024-01-02 {hour:02d}:07:00" for n in ("call_end_time", "call_start_time")}
        want = ",".join(cell.get(n, "9") for n in headers[hour])
        assert lines == [",".join(headers[hour]), *[want] * rows, *(["200,broken"] if hour % 5 == 0 else [])]


@pytest.mark.parametrize("before", [None, "12345"])
def test_the_limit_of_methods_is_put_back(spark, before):
    if before:
        spark.conf.set(LIMIT, before)
    try:
        outside = spark.conf.get(LIMIT)
        with pytest.raises(ValueError), small_methods(spark):
            assert spark.conf.get(LIMIT) == "8000"
            raise ValueError
        assert spark.conf.get(LIMIT) == outside
    finally:
        spark.conf.unset(LIMIT)


def test_records_are_loaded_in_small_methods(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path / "landing"), {}
    star.write_hour_files(_records(spark, [1]), root)
    replace_hours = VersionedStore.replace_hours

    def noted(store, table, rows):
        seen[table] = spark.conf.get(LIMIT)
        replace_hours(store, table, rows)

    monkeypatch.setattr(VersionedStore, "replace_hours", noted)
    options = ingest.IngestOptions(lookback_days=None, min_age_seconds=0)
    ingest.ingest_cycle(VersionedStore(spark, str(tmp_path / "store")), src.Landing(root, star.STAR_ENTITIES, src.HOUR_FOLDER), datetime(2100, 1, 1), options)
    assert seen["records"] == "8000" and seen["media"] != "8000"


def test_absent_cells_are_not_tried(spark, capsys):
    cells = spark.createDataFrame([(t,) for t in (None, "", "  ", " 2.5 ", "nan", "x", "1704067200", "02 Jan 2024 10:00:00")], "t string")
    read = cells.select("t", best_effort_float(F.col("t")).alias("f"), best_effort_timestamp(F.col("t")).alias("at"))
    rows = {r["t"]: (r["f"], r["at"] is not None) for r in read.collect()}
    assert rows == {None: (None, False), "": (None, False), "  ": (None, False), " 2.5 ": (2.5, False), "nan": (None, False), "x": (None, False),
                    "1704067200": (None, True), "02 Jan 2024 10:00:00": (None, True)}
    for parser in (best_effort_float, best_effort_timestamp):
        cells.select(parser(F.col("t"))).explain("extended")
        plan = capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]
        assert "= )" in plan


def test_a_record_meets_the_list_of_files_once(spark, tmp_path):
    root, now = str(tmp_path / "landing"), datetime(2100, 1, 1)
    star.write_hour_files(_records(spark, [1, 4]), root)
    files = src.with_headers(src.discover(spark, src.Landing(root, star.STAR_ENTITIES, src.HOUR_FOLDER), now, None, 0))
    listed = spark.createDataFrame(files.where("header_error IS NULL").collect(), files.schema)
    typed = src.typed_records(src.read_cells(spark, listed), now)
    assert typed._jdf.queryExecution().executedPlan().toString().count("HashJoin ") == 1
    rows = {r["callid"]: r for r in typed.where("NOT malformed").collect()}
    assert {(c, r["entity"], r["file_hour"]) for c, r in rows.items()} == {(f"c{h}", "E1", datetime(2024, 1, 2, h)) for h in (1, 4)}
    assert all(r["file_path"] in {f["file_path"] for f in listed.collect()} and r["pdd"] == 9 and r["bad_cells"] == 0 for r in rows.values())


def test_no_record_has_its_path_made_plain(spark, tmp_path, capsys):
    root, now = str(tmp_path / "land+ed"), datetime(2100, 1, 1)
    star.write_hour_files(_records(spark, [1, 4, 5]), root)
    files = src.with_headers(src.discover(spark, src.Landing(root, star.STAR_ENTITIES, src.HOUR_FOLDER), now, None, 0))
    listed = spark.createDataFrame(files.where("header_error IS NULL").collect(), files.schema)
    cells = src.read_cells(spark, listed)
    cells.explain("extended")
    assert "_metadata" not in capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    found = {(r["file_path"], r["malformed"]) for r in cells.collect()}
    paths = {r["file_hour"].hour: r["file_path"] for r in listed.collect()}
    assert found == {(paths[h], False) for h in (1, 4, 5)} | {(paths[5], True)}


def test_what_a_cell_says_is_one_number(spark):
    cells = spark.createDataFrame([("f", "E1", datetime(2024, 1, 1, 5), 1, 2, False)], "file_path string, entity string, file_hour timestamp, source_size long, source_mtime_ms long, malformed boolean")
    texts = {n: "" for n in src.SOURCE_COLUMNS} | {"sip_code": "x", "pdd": "7", "orig_cost": " ", "call_end_time": "never", "mos_max": "nan", "call_start_time": "2024-01-01 05:00:00"}
    typed = src.typed_records(cells.withColumns({n: F.lit(t) for n, t in texts.items()}), datetime(2100, 1, 1))
    assert "said_" not in typed._jdf.queryExecution().analyzed().toString()
    row = typed.first()
    assert (row["bad_cells"], row["sip_code"], row["pdd"], row["orig_cost"], row["call_end_time"], row["mos_max"]) == (3, 0, 7, 0.0, None, 0.0)


def test_paths_have_one_spelling(spark):
    paths = {"file:/a": "file:///a", "file:////a": "file:///a", "file:///a": "file:///a", "file:a": "file:a", "s3a://b/file:/a": "s3a://b/file:/a", None: None}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", src.plain_path(F.col("p")).alias("plain")).collect()
    assert {r["p"]: r["plain"] for r in rows} == paths
