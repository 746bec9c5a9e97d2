"""Registered queries that go through files: landing, store, log, exports, streams.

Records are written out as compressed files, one per entity and source hour, under 24 different
headers, with broken lines and a file that is refused, and loaded back, which is what the twins check.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.functions import metrics
from callmeter.operators.coverage import missing_days, missing_hours, needed_days
from callmeter.operators.versions import latest_version
from callmeter.plans import detail, ingest, reports, rollups, snapshots, watchlist
from callmeter.plans.snapshots import SnapshotStore, latest_complete_day, store_daily_snapshot
from callmeter.registry import (
    _CUST_SQL, _HITS_SQL, _MEDIA_SQL, _WATCH_SQL, _REASON_SQL, _RELEASE, _grouped_sql, _hot_sql, _panel, _top, _with, CDR, CUST, HOT_DAY, PARAMS,
    _SCOPE, _WINDOW_SQL, _state_sql, _watchlist, query,
)
from callmeter.runtime import Folder, fresh_path
from callmeter.schema import WATCHLIST_SCHEMA
from callmeter.sources import landing as src
from callmeter.sources.commits import VersionedStore
from callmeter.sources.landing import HOUR_FOLDER, Landing
from callmeter.sources.manifest import already_loaded, decide, load_problems
from callmeter.sources.sinks import CODE_EXPORT_COLUMNS, complete_only, write_csv, write_json
from callmeter.sources.star_records import FIRST_DAY, LAST_DAY, STAR_ENTITIES, WATCHED, read_table, slices_of, star_area_codes, star_records, write_hour_files
from callmeter.sources.store import store_stats
from callmeter.streaming.arrivals import stream_media_partials, watch_landing
from callmeter.streaming.windows import exact_windows, partial_batches, summed_windows

# Long after every file of a run has been written.
_LATER = datetime(2100, 1, 1)
CODES = reports.CODE_KEYS
_EVERYTHING = ingest.IngestOptions(lookback_days=None, min_age_seconds=0)
# Paths prepared by this process, per application and data folder.
_PREPARED: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf: str, build):
    """What ``build`` prepared earlier, unless the shared folder was cleared since."""
    key = (kind, spark.sparkContext.applicationId, sf)
    made = _PREPARED.get(key)
    if made is None or not Folder(spark).exists(getattr(made, "root", made)):
        made = _PREPARED[key] = build()
    return made


def _landing(spark: SparkSession, sf: str) -> Landing:
    def build() -> Landing:
        root = fresh_path(spark, "landing")
        write_hour_files(star_records(spark, sf), root, slices_of(read_table(spark, sf, "lineitem").count()))
        return Landing(root, STAR_ENTITIES, HOUR_FOLDER)

    return _once("landing", spark, sf, build)


def _store(spark: SparkSession, sf: str) -> VersionedStore:
    """Store filled by batch cycles over the landing folder."""

    def build() -> VersionedStore:
        store = VersionedStore(spark, fresh_path(spark, "store"))
        ingest.set_watchlist(store, _watchlist(spark))
        ingest.backfill(store, _landing(spark, sf), _LATER, None, _EVERYTHING)
        return store

    return _once("store", spark, sf, build)


# --- loading ---------------------------------------------------------------------------

_DAY = "event_time::DATE"


@query("ingested_hours", _with(f"""
SELECT entity, file_hour, count(*) AS rows, sum(orig_billed_duration)::BIGINT AS seconds,
sum(orig_cost::DECIMAL(18,8))::DOUBLE AS revenue, count(DISTINCT callid) AS calls, max(call_end_time) AS last_end
FROM cdr GROUP BY 1, 2"""))
def _(spark, sf):
    """Source hours after loading compressed text files."""
    return _store(spark, sf).records.groupBy("entity", "file_hour").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("orig_billed_duration").alias("seconds"),
        metrics.from_units(F.sum(metrics.to_units("orig_cost"))).alias("revenue"),
        F.count_distinct("callid").alias("calls"), F.max("call_end_time").alias("last_end"),
    )


@query("ingested_customer_codes", _with(_top(_CUST_SQL, "revenue DESC", CUST)))
def _(spark, sf):
    return reports.customer_codes_report(_store(spark, sf).records, PARAMS).rows


@query("ingested_detail", _with(f"""
SELECT call_start_time AS start_time, from_did AS ani, to_did AS dnis,
coalesce(orig_trunk_group_name, '') AS customer_trunk, sip_code, {_RELEASE} AS release_reason,
coalesce(nullif(orig_billed_prefix, ''), '?') AS billed_prefix, coalesce(term_state, '') AS state,
coalesce(term_ratecenter, '') AS rate_center, entity, callid FROM cdr ORDER BY event_time DESC, callid, call_start_time LIMIT 10000"""))
def _(spark, sf):
    return detail.call_detail(_store(spark, sf).records)


@query("ingested_media_rollup", _panel("SELECT * FROM media", _MEDIA_SQL))
def _(spark, sf):
    return rollups.merged_media(_store(spark, sf).media)


@query("ingested_reason_rollup", _panel("SELECT * FROM reasons", _REASON_SQL))
def _(spark, sf):
    return rollups.merged_reasons(_store(spark, sf).reasons)


@query("ingested_watch_matches", _panel("""
SELECT termination_media_ip, entity, orig_trunk_group_name, term_carrier_name, term_trunk_group_name, term_ip,
min(hour) AS first_seen, max(hour) AS last_seen, sum(matching_cdrs)::BIGINT AS matching_cdrs FROM hits
GROUP BY 1,2,3,4,5,6""", f"{_MEDIA_SQL}, {_HITS_SQL}"))
def _(spark, sf):
    return watchlist.watched_matches(_store(spark, sf).hits, limit=None)


@query("ingest_summary", _with("SELECT 'done' AS status, count(*) AS rows FROM cdr UNION ALL SELECT 'error', 0"))
def _(spark, sf):
    log = _store(spark, sf).manifest.latest
    return log.groupBy("status").agg(F.sum("rows_ingested").alias("rows"))


@query("ingest_again_skips", _with("SELECT 'skipped' AS status, count(*) AS rows FROM cdr UNION ALL SELECT 'error', 0"))
def _(spark, sf):
    """A second cycle over unchanged files loads nothing; the refused file is tried again."""
    outcome = ingest.ingest_cycle(_store(spark, sf), _landing(spark, sf), _LATER, _EVERYTHING)
    return ingest.cycle_summary(outcome).drop("files")


@query("header_contract", _with("""
SELECT DISTINCT entity, file_hour, true AS accepted,
(27 - CASE WHEN hour(file_hour) % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN hour(file_hour) % 4 = 0 THEN 1 ELSE 0 END)::INT AS columns
FROM cdr UNION ALL SELECT 'E3', TIMESTAMP '2024-01-31 05:00:00', false, 3"""))
def _(spark, sf):
    """Headers differ by hour of the day and are acceptable, but for one file that lacks a column."""
    files = src.discover(spark, _landing(spark, sf), _LATER, None, 0)
    checked = src.with_headers(files)
    return checked.select(
        "entity", "file_hour", F.col("header_error").isNull().alias("accepted"), F.size("header").alias("columns")
    ).distinct()


@query("ingest_mixed_headers", _with("""
SELECT entity, file_hour, count(*) AS rows, CASE WHEN hour(file_hour) % 3 = 0 THEN 0 ELSE sum(duration_real) END::BIGINT AS talk_seconds,
sum(orig_billed_duration)::BIGINT AS billed_seconds, max(term_media_ip) AS media_ip, CASE WHEN hour(file_hour) % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS broken_lines
FROM cdr GROUP BY 1, 2"""))
def _(spark, sf):
    """Files of 24 headers read in one scan: each cell by the header of its own file, absent columns as zero, broken lines counted."""
    store, hour = _store(spark, sf), ["entity", "file_hour"]
    loaded = store.records.groupBy(*hour).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("duration_real").alias("talk_seconds"), F.sum("orig_billed_duration").alias("billed_seconds"),
        F.max(F.coalesce("term_media_ip", F.lit(""))).alias("media_ip"),
    )
    broken = store.manifest.latest.groupBy(*hour).agg(F.sum("malformed_rows").alias("broken_lines"))
    return loaded.join(broken, hour)


@query("cold_store", _with(f"""
SELECT entity, {_DAY} AS file_date, count(*) AS rows, sum(term_cost::DECIMAL(18,8))::DOUBLE AS cost
FROM cdr GROUP BY 1, 2"""))
def _(spark, sf):
    def build() -> str:
        path = fresh_path(spark, "cold")
        files = src.discover(spark, _landing(spark, sf), _LATER, None, 0)
        while ingest.write_cold_store(files, path, _LATER).where("status = 'waiting'").limit(1).count():
            pass
        return f"{path}/hours"

    cold = spark.read.parquet(_once("cold", spark, sf, build))
    return cold.groupBy("entity", "file_date").agg(
        F.count(F.lit(1)).alias("rows"),
        metrics.from_units(F.sum(metrics.to_units("term_cost"))).alias("cost"),
    )


@query("store_stats", _with(f"""
SELECT count(*) AS total_rows, min(file_hour) AS oldest_hour, max(file_hour) AS newest_hour,
count(DISTINCT entity) AS entity_count FROM cdr"""))
def _(spark, sf):
    # How many part files a day has is up to the writer, so that count is left out.
    return _store(spark, sf).stats().drop("files_ingested")


@query("retention", _with(f"""
SELECT entity, {_DAY} AS file_date, count(*) AS rows FROM cdr WHERE {_DAY} >= DATE '2024-01-16' GROUP BY 1, 2"""))
def _(spark, sf):
    """Whole source hours before the cutoff are gone from a store of their own."""

    def build() -> VersionedStore:
        store = VersionedStore(spark, fresh_path(spark, "rolling"))
        store.copy_table("records", _store(spark, sf))
        store.drop_before(datetime(2024, 1, 16))
        return store

    kept = _once("retention", spark, sf, build).records
    return kept.groupBy("entity", "file_date").agg(F.count(F.lit(1)).alias("rows"))


# --- changes of a store: commits, the watchlist, event hours ----------------------------------

_ALL_TABLES = ("records", "media", "reasons", "hits")
# The list after two addresses came and one went.
_NEW_LIST = ("203.0.113.12", "203.0.113.50", "203.0.113.5")
_REDONE = [("E1", date(2024, 1, 15), hour) for hour in range(24)]


@dataclass(frozen=True)
class _Changed:
    root: str
    relisted: VersionedStore
    replaced: VersionedStore
    newest: VersionedStore


def _changed_store(spark: SparkSession, sf: str) -> _Changed:
    """A copy of the store after three changes: another watchlist, one sender's day replaced by its answered calls, and a
    replacement of that day that died after its first table."""

    def build() -> _Changed:
        source, store = _store(spark, sf), VersionedStore(spark, fresh_path(spark, "changed"))
        with store.change() as to:
            to.put_watchlist(source.watchlist)
            for table in _ALL_TABLES:
                to.copy_table(table, source)
        ingest.change_watchlist(
            store, spark.createDataFrame([(ip,) for ip in _NEW_LIST[1:]], WATCHLIST_SCHEMA), spark.createDataFrame([(WATCHED[0],)], WATCHLIST_SCHEMA)
        )
        relisted = store.pinned()
        answered = relisted.read_hours("records", _REDONE).where("sip_code = 200")
        with store.change() as to:
            for table in _ALL_TABLES:
                to.drop_hours(table, _REDONE)
            to.replace_hours("records", answered)
            ingest.derive_hours(to, _REDONE)
        replaced = store.pinned()
        try:
            with store.change() as to:
                to.replace_hours("records", relisted.read_hours("records", _REDONE).limit(0))
                to.drop_hours("records", _REDONE)
                raise InterruptedError("between two tables")
        except InterruptedError:
            pass
        return _Changed(store.root, relisted, replaced, store)

    return _once("changed", spark, sf, build)


_NEW_WATCH_SQL = "watch(ip) AS (VALUES " + ", ".join(f"('{ip}')" for ip in _NEW_LIST) + ")"
_NEW_HITS_SQL = _HITS_SQL.replace(_WATCH_SQL, _NEW_WATCH_SQL)


@query("watchlist_delta", _panel("""
SELECT termination_media_ip, entity, orig_trunk_group_name, term_carrier_name, term_trunk_group_name, term_ip,
min(hour) AS first_seen, max(hour) AS last_seen, sum(matching_cdrs)::BIGINT AS matching_cdrs FROM hits
GROUP BY 1,2,3,4,5,6""", f"{_MEDIA_SQL}, {_NEW_HITS_SQL}"))
def _(spark, sf):
    """Hits after one address was taken off the list and two were put on: the same as a full rebuild."""
    return watchlist.watched_matches(_changed_store(spark, sf).relisted.hits, limit=None)


_KEPT = "NOT (entity = 'E1' AND file_hour::DATE = DATE '2024-01-15') OR sip_code = 200"


def _state_of_tables(name: str, where: str) -> str:
    hit = f"trim(term_media_ip) IN {_NEW_LIST}"
    return f"""SELECT '{name}' AS state, entity, file_hour::DATE AS file_date, count(*) AS records, count(*) AS media_attempts,
    count(*) AS reason_attempts, count(*) FILTER ({hit}) AS hits FROM cdr WHERE {where} GROUP BY 2, 3"""


@query("ingest_commit_isolation", _with(" UNION ALL ".join([
    _state_of_tables("pinned", "true"), _state_of_tables("replaced", _KEPT), _state_of_tables("after_crash", _KEPT)])))
def _(spark, sf):
    """Four tables as seen by a reader pinned before a replacement, by one after it, and by one after a replacement that died half way."""
    changed = _changed_store(spark, sf)
    day = ["entity", "file_date"]
    counted = {"records": F.count(F.lit(1)), "media_attempts": F.sum("attempts"), "reason_attempts": F.sum("attempts"), "hits": F.sum("matching_cdrs")}

    def state(name: str, store: VersionedStore) -> DataFrame:
        parts = [store.read(t).groupBy(*day).agg(e.alias(n)) for t, (n, e) in zip(_ALL_TABLES, counted.items(), strict=True)]
        joined = reduce(lambda a, b: a.join(b, day, "full"), parts)
        return joined.select(F.lit(name).alias("state"), *day, *[F.coalesce(n, F.lit(0)).alias(n) for n in counted])

    states = {"pinned": changed.relisted, "replaced": changed.replaced, "after_crash": changed.newest}
    return reduce(DataFrame.unionByName, [state(n, s) for n, s in states.items()])


@query("event_hour_pruned", _with("""
SELECT entity, event_time::DATE AS day, count(*) AS calls, sum(orig_billed_duration)::BIGINT AS seconds FROM cdr
WHERE date_trunc('hour', event_time) BETWEEN TIMESTAMP '2024-01-09 22:00:00' AND TIMESTAMP '2024-01-12 03:00:00' GROUP BY 1, 2"""))
def _(spark, sf):
    """Calls by the hour of the event: only source hours whose zone meets the range are opened."""
    rows = _store(spark, sf).read_events("records", datetime(2024, 1, 9, 22), datetime(2024, 1, 12, 3))
    return rows.groupBy("entity", F.to_date("event_time").alias("day")).agg(F.count("*").alias("calls"), F.sum("orig_billed_duration").alias("seconds"))


# --- the load log ----------------------------------------------------------------------------

# One file per entity and hour of the records; the log knows an older state of some.
_FILES_SQL = """
files AS (SELECT entity || '/' || strftime(file_hour, '%Y-%m-%d %H') AS file_path, entity, file_hour,
count(*) AS source_size, max(epoch(call_end_time))::BIGINT AS source_mtime_ms FROM cdr GROUP BY 1, 2, 3),
log AS (SELECT file_path, entity, file_hour, source_mtime_ms, source_size + CASE WHEN source_size % 7 = 0 THEN 1 ELSE 0 END
AS source_size, source_size AS rows_ingested, CASE source_size % 5 WHEN 0 THEN 'ingesting' WHEN 1 THEN 'changed'
WHEN 2 THEN 'error' ELSE 'done' END AS status FROM files WHERE source_mtime_ms % 11 <> 0)
"""


def _files_and_log(spark, sf) -> tuple[DataFrame, DataFrame]:
    files = star_records(spark, sf).groupBy("entity", "file_hour").agg(
        F.count(F.lit(1)).alias("source_size"),
        F.max(F.unix_timestamp("call_end_time")).alias("source_mtime_ms"),
    ).withColumn("file_path", F.concat_ws("/", "entity", F.date_format("file_hour", "yyyy-MM-dd HH")))
    size = F.col("source_size")
    status = (
        F.when(size % 5 == 0, "ingesting").when(size % 5 == 1, "changed")
        .when(size % 5 == 2, "error").otherwise("done")
    )
    log = files.where(F.col("source_mtime_ms") % 11 != 0).select(
        "file_path", "entity", "file_hour", "source_mtime_ms",
        (size + F.when(size % 7 == 0, 1).otherwise(0)).alias("source_size"),
        size.alias("rows_ingested"), status.alias("status"),
    )
    return files, log


@query("coverage_missing", f"""WITH {CDR}, {_FILES_SQL}
SELECT f.entity, f.file_hour FROM files f LEFT JOIN log USING (file_path)
WHERE NOT coalesce(log.source_size = f.source_size AND log.source_mtime_ms = f.source_mtime_ms, false)""")
def _(spark, sf):
    return missing_hours(*_files_and_log(spark, sf))


@query("coverage_missing_days", f"""WITH {CDR}, {_FILES_SQL}
SELECT e.entity, d.day::DATE AS day FROM (SELECT unnest(['E0','E1','E2','E3']) AS entity) e,
(SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) d
WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.entity = e.entity AND log.file_hour::DATE = d.day::DATE
AND status = 'changed' AND rows_ingested % 3 = 0)""")
def _(spark, sf):
    _, log = _files_and_log(spark, sf)
    chosen = log.where("status = 'changed' AND rows_ingested % 3 = 0")
    return missing_days(needed_days(spark, STAR_ENTITIES, FIRST_DAY, LAST_DAY), chosen)


@query("guarded_export", _with(f"SELECT {', '.join(CODE_EXPORT_COLUMNS)} FROM ({_top(_grouped_sql(reports.CODE_KEYS), 'revenue DESC', reports.CODE_KEYS)})"))
def _(spark, sf):
    """The code report for export; every day that has calls must be in the list of files, or the plan fails."""
    records = star_records(spark, sf)
    days = records.select("entity", F.to_date("file_hour").alias("day")).distinct()
    report = reports.codes_report(records, PARAMS)
    return complete_only(report.rows, missing_days(days, _files_and_log(spark, sf)[0]), cap=PARAMS.limit).select(*CODE_EXPORT_COLUMNS)


@query("already_loaded", f"""WITH {CDR}, {_FILES_SQL}
SELECT f.file_path FROM files f JOIN log USING (file_path)
WHERE log.source_size = f.source_size AND log.source_mtime_ms = f.source_mtime_ms""")
def _(spark, sf):
    return already_loaded(*_files_and_log(spark, sf)).select("file_path")


def _decision_sql(change: str) -> str:
    keep = "log.source_size = f.source_size AND log.source_mtime_ms = f.source_mtime_ms"
    open_ = "log.status IN ('ingesting', 'error') AND f.source_size % 2 = 0"
    if change == "replace":
        rules = f"WHEN log.status = 'changed' AND {keep} THEN 'ingest' WHEN log.status IN ('done','changed') AND {keep} " \
                "THEN 'skip' ELSE 'ingest'"
    else:
        rules = f"WHEN log.status IN ('done','changed') AND {keep} THEN 'skip' " \
                "WHEN log.status IN ('done','changed') THEN 'changed' " \
                f"WHEN {open_} AND {keep} THEN 'recover' WHEN {open_} THEN 'changed' ELSE 'ingest'"
    return f"""WITH {CDR}, {_FILES_SQL} SELECT f.file_path, CASE WHEN log.status IS NULL THEN 'ingest' {rules} END
AS action FROM files f LEFT JOIN log USING (file_path)"""


def _decision_query(change: str):
    @query(f"load_decisions_{change}", _decision_sql(change))
    def _(spark, sf):
        files, log = _files_and_log(spark, sf)
        stored = files.where("source_size % 2 = 0").select("entity", "file_hour", F.col("source_size").alias("rows"))
        return decide(files, log, stored, change).select("file_path", "action")


_decision_query("replace")
_decision_query("flag")

_LINES_SQL = """
lines AS (SELECT entity || '/' || strftime(file_hour, '%Y-%m-%d %H') AS file_path, entity, file_hour, sip_code AS seq,
max(event_time) AS updated_at, count(*) AS rows_ingested, CASE WHEN sip_code = 200 THEN 'done' WHEN sip_code = 503
THEN 'error' ELSE 'changed' END AS status, 'sip ' || sip_code AS message FROM cdr GROUP BY 1, 2, 3, 4),
newest AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC, seq DESC) = 1)
"""


def _log_lines(spark, sf) -> DataFrame:
    """One log line per file and SIP code, as if each had been a load step."""
    code = F.col("seq")
    return (
        star_records(spark, sf).groupBy("entity", "file_hour", F.col("sip_code").alias("seq"))
        .agg(F.max("event_time").alias("updated_at"), F.count(F.lit(1)).alias("rows_ingested"))
        .withColumns({
            "file_path": F.concat_ws("/", "entity", F.date_format("file_hour", "yyyy-MM-dd HH")),
            "status": F.when(code == 200, "done").when(code == 503, "error").otherwise("changed"),
            "message": F.concat_ws(" ", F.lit("sip"), code),
        })
    )


@query("latest_manifest", f"WITH {CDR}, {_LINES_SQL} SELECT * FROM newest")
def _(spark, sf):
    return latest_version(_log_lines(spark, sf), ["file_path"], ["updated_at", "seq"])


@query("load_problems", f"""WITH {CDR}, {_LINES_SQL}
SELECT entity, file_hour, file_path, status, message, rows_ingested, updated_at FROM newest
WHERE status IN ('error', 'changed') ORDER BY updated_at DESC, file_path LIMIT 100""")
def _(spark, sf):
    return load_problems(latest_version(_log_lines(spark, sf), ["file_path"], ["updated_at", "seq"]))


@query("manifest_stats", f"""WITH {CDR}, {_LINES_SQL} SELECT (SELECT count(*) FROM cdr) AS total_rows,
(SELECT count(*) FROM newest) AS files_ingested, min(file_hour) AS oldest_hour, max(file_hour) AS newest_hour,
count(DISTINCT entity) AS entity_count FROM cdr""")
def _(spark, sf):
    newest = latest_version(_log_lines(spark, sf), ["file_path"], ["updated_at", "seq"])
    return store_stats(star_records(spark, sf), newest)


# --- exports ---------------------------------------------------------------------------------------

_EXPORT_SQL = f"SELECT * RENAME (customer AS origin_trunk) FROM ({_CUST_SQL})"


def _export(spark, sf) -> DataFrame:
    return reports.customer_codes_export(star_records(spark, sf), PARAMS)


@query("export_customer_codes", _with(_EXPORT_SQL))
def _(spark, sf):
    """All rows, written as ordered CSV parts and read back."""

    def build() -> str:
        path = fresh_path(spark, "export-csv")
        write_csv(_export(spark, sf), path, reports.EXPORT_COLUMNS)
        return path

    path = _once("export-csv", spark, sf, build)
    return spark.read.schema(_export(spark, sf).schema).option("header", True).option("escape", '"').csv(path)


_STATE_HEAD, _STATE_GROUPED = _state_sql("orig")


@query("export_customer_state", f"{_STATE_HEAD} {_STATE_GROUPED}")
def _(spark, sf):
    """Trunk × state rows with the state first, as CSV and back."""
    rows = reports.customer_state_report(star_records(spark, sf), PARAMS, star_area_codes(spark)).rows

    def build() -> str:
        path = fresh_path(spark, "export-state")
        write_csv(rows, path, reports.STATE_EXPORT_COLUMNS)
        return path

    schema = rows.select(*reports.STATE_EXPORT_COLUMNS).schema
    return spark.read.schema(schema).option("header", True).csv(_once("export-state", spark, sf, build))


@query("export_json", _with(_EXPORT_SQL))
def _(spark, sf):
    def build() -> str:
        path = fresh_path(spark, "export-json")
        write_json(_export(spark, sf), path)
        return path

    return spark.read.schema(_export(spark, sf).schema).json(_once("export-json", spark, sf, build))


# --- stored snapshots --------------------------------------------------------------------------------

def _snapshots(spark, sf) -> SnapshotStore:
    def build() -> SnapshotStore:
        snaps = SnapshotStore(spark, fresh_path(spark, "snapshots"))
        records = _store(spark, sf).records
        for day, final in ((18, True), (19, True), (20, False)):
            at = datetime(2024, 1, day + 1, 3 if final else 1)
            store_daily_snapshot(records, snaps, datetime(2024, 1, day).date(), STAR_ENTITIES, at, f"run{day}")
        return snaps

    return _once("snapshots", spark, sf, build)


_ONE_DAY = _grouped_sql(CUST, f"{_SCOPE} AND {_DAY} = DATE '2024-01-19'", signature=True)


@query("daily_snapshot_rows", _with(
    f"SELECT *, DATE '2024-01-19' AS end_date, 'run19' AS run_id FROM ({_top(_ONE_DAY, 'revenue DESC', CUST)})"))
def _(spark, sf):
    """Rows of the newest finished day: the one of the 20th was computed too early."""
    snaps = _snapshots(spark, sf)
    entry = latest_complete_day(snaps.index, "customer-codes", datetime(2024, 1, 21).date())
    return snaps.rows(entry, "customer-codes")


@query("hot_set_stored", f"""WITH {CDR}, {_WINDOW_SQL} SELECT 'codes' AS report, * FROM (
SELECT "window", entity, count(*) AS rows, sum(attempts)::BIGINT AS attempts, sum(revenue::DECIMAL(18,4))::DOUBLE AS revenue FROM (
SELECT * FROM ({_hot_sql(CODES, False)}) QUALIFY row_number() OVER (PARTITION BY "window", entity ORDER BY revenue DESC NULLS LAST, {', '.join(CODES)}) <= 500) GROUP BY 1, 2)
UNION ALL SELECT 'customer-codes' AS report, * FROM (
SELECT "window", entity, count(*) AS rows, sum(attempts)::BIGINT AS attempts, sum(revenue::DECIMAL(18,4))::DOUBLE AS revenue FROM (
SELECT * FROM ({_hot_sql(CUST, True)}) QUALIFY row_number() OVER (PARTITION BY "window", entity ORDER BY revenue DESC NULLS LAST, {', '.join(CUST)}) <= 500) GROUP BY 1, 2)""")
def _(spark, sf):
    """All sixty prepared results, stored by one job per report under the keys of their requests and read back by these."""

    def build() -> SnapshotStore:
        snaps = SnapshotStore(spark, fresh_path(spark, "hot"))
        for report in snapshots.HOT_REPORTS:
            snapshots.store_hot_set(star_records(spark, sf), snaps, report, HOT_DAY, STAR_ENTITIES, datetime(2024, 1, 20, 12), "hot1", limit=500)
        return snaps

    snaps = _once("hot", spark, sf, build)
    parts = []
    for report in snapshots.HOT_REPORTS:
        requests = snapshots.hot_requests(spark, report, HOT_DAY, STAR_ENTITIES, 500)
        rows = snaps.rows(snaps.index, report, with_key=True).join(F.broadcast(requests.select("snapshot_key", "window", "entity")), "snapshot_key")
        parts.append(rows.groupBy("window", "entity").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("attempts").alias("attempts"), F.sum(F.col("revenue").cast("decimal(18,4)")).cast("double").alias("revenue"),
        ).withColumn("report", F.lit(report)))
    return reduce(DataFrame.unionByName, parts)


# --- streams --------------------------------------------------------------------------------------------

def _table_stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table read as a file stream, be it one file or a folder of parts."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    # As a pattern, since a plain file path is not accepted as a stream source.
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 200)
        .parquet(f"{sf}/{table}.parque[t]")
    )


_LATE_PART = "event_id % 3 = 0"


@query("events_hourly_stream", f"""
WITH seen AS (SELECT max(ts) AS newest FROM events WHERE NOT ({_LATE_PART}))
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value::DECIMAL(18,8))::DOUBLE AS total,
count(*) FILTER ({_LATE_PART} AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= newest - INTERVAL 1 HOUR) AS late_rows
FROM events, seen GROUP BY 1, 2""")
def _(spark, sf):
    """Hourly windows over a file stream whose second delivery is out of order: a third of all events, spread over the
    whole time, arrives after the rest. The windows are exact with a delay of one hour, and late rows are counted."""

    def build() -> str:
        path, arrivals, state = (fresh_path(spark, n) for n in ("windows", "arrivals", "windows-state"))
        events = read_table(spark, sf, "events")
        measures = {"n": F.count(F.lit(1)), "units": F.sum(metrics.to_units("value"))}
        for late in (False, True):
            events.where(F.expr(_LATE_PART) == late).write.mode("append").parquet(arrivals)
            stream = spark.readStream.schema(events.schema).parquet(arrivals)
            exact_windows(stream, "ts", ["event_type"], measures, path, state).awaitTermination()
        return path

    windows = summed_windows(spark, _once("windows", spark, sf, build), ["event_type"], ["n", "units"])
    return windows.select("hour", "event_type", "n", metrics.from_units(F.col("units")).alias("total"), "late_rows")


@query("media_rollup_stream", _panel("SELECT * FROM media", _MEDIA_SQL))
def _(spark, sf):
    """Records arriving as a stream, rolled up per micro-batch and merged on read."""

    def build() -> str:
        path = fresh_path(spark, "partials")
        stream = _table_stream(spark, sf, "lineitem")
        records = star_records(spark, sf, lineitem=stream)
        stream_media_partials(records, path, fresh_path(spark, "partials-state")).awaitTermination()
        return path

    return rollups.merged_media(partial_batches(spark, _once("partials", spark, sf, build)))


@query("landing_stream", _with(f"""
SELECT entity, file_hour, count(*) AS rows FROM cdr GROUP BY 1, 2"""))
def _(spark, sf):
    """The landing folder loaded by the file stream instead of a batch cycle."""

    def build() -> VersionedStore:
        store = VersionedStore(spark, fresh_path(spark, "streamed"))
        watch_landing(
            store, _landing(spark, sf), fresh_path(spark, "streamed-state"), _EVERYTHING,
            once=True, clock=lambda: _LATER,
        ).awaitTermination()
        return store

    return rollups.hour_counts(_once("streamed", spark, sf, build).records)
