"""Loading source files: one distributed job per table and cycle, not one per file."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from callmeter.plans import rollups
from callmeter.plans.watchlist import watch_hits
from callmeter.runtime import Folder, has_rows_on_disk, pin_utc, small_methods, written
from callmeter.schema import PARTITIONS
from callmeter.sources import landing as src
from callmeter.sources.landing import Landing
from callmeter.sources.manifest import already_loaded, decide
from callmeter.sources.store import CallStore, with_partitions, write_hours

RETENTION_DAYS = 4
# Files one job loads (oldest first); the rest follows in the next job of the cycle.
MAX_FILES = 5000
# Compressed bytes of the files one job loads, but for the rest of an hour: a load shuffles about three times as much.
MAX_BYTES = 4 << 30

_HOUR = ("entity", "file_hour")


@dataclass(frozen=True)
class IngestOptions:
    lookback_days: int | None = src.LOOKBACK_DAYS
    min_age_seconds: int = src.MIN_AGE_SECONDS
    on_change: str = "replace"
    max_files: int = MAX_FILES
    max_bytes: int = MAX_BYTES


def _hours(df: DataFrame) -> list[tuple]:
    """Distinct source hours of a cycle's file list."""
    rows = with_partitions(df.select(*_HOUR)).select(*PARTITIONS).distinct().collect()
    return sorted(map(tuple, rows))


def _stored_counts(store: CallStore, files: DataFrame, latest: DataFrame) -> DataFrame:
    """Stored rows of the hours whose load was interrupted; no other hour is touched."""
    open_files = files.join(
        latest.where(F.col("status").isin("ingesting", "error")), "file_path", "left_semi"
    )
    return rollups.hour_counts(store.read_hours("records", _hours(open_files)))


def plan_cycle(store: CallStore, files: DataFrame, on_change: str) -> DataFrame:
    """Action per discovered file, frozen so that later log lines do not change it."""
    latest = store.manifest.latest
    if on_change == "flag" and has_rows_on_disk(store.spark, store.manifest.path):
        counts = _stored_counts(store, files, latest)
    else:
        # Replacing runs an interrupted load again, whatever it left behind.
        counts = store.spark.createDataFrame([], "entity string, file_hour timestamp, rows long")
    return written(decide(files, latest, counts, on_change), "cycle")


def derive_hours(store: CallStore, hours: list[tuple]) -> None:
    """Rebuild the rollups and watch hits of some source hours from the stored records."""
    with store.change() as to:
        records = to.read_hours("records", hours)
        for table, build in (("media", rollups.media_rollup), ("reasons", rollups.reason_rollup)):
            to.replace_hours(table, build(records))
        refresh_hits(to, hours)


def refresh_hits(store: CallStore, hours: list[tuple]) -> None:
    """Watch hits of some source hours; hours that lost their last hit are emptied too."""
    with store.change() as to:
        if not to.has_watchlist():
            to.drop_hours("hits", hours)
            return
        # Worked out before the old ones go, so that a failure leaves these in place.
        hits = written(watch_hits(to.read_hours("media", hours), to.watchlist), "hits")
        to.drop_hours("hits", hours)
        to.replace_hours("hits", hits)


def set_watchlist(store: CallStore, addresses: DataFrame) -> None:
    """Make the watchlist exactly ``addresses`` and rebuild the hits of all history.

    List and hits are worked out before the stored ones are touched: a failure on the way leaves
    both as they were, and ``addresses`` may come from the stored list.
    """
    listed = written(addresses.select("termination_media_ip").distinct(), "watchlist")
    hits = written(watch_hits(store.media, listed), "hits")
    with store.change() as to:
        to.put_watchlist(listed)
        to.drop_all("hits")
        to.replace_hours("hits", hits)


def change_watchlist(store: CallStore, added: DataFrame, removed: DataFrame) -> None:
    """Take addresses off the list and put others on, touching only the hours where that changes a hit.

    Hits of an added address come from the rollup rows of that address, those of a removed one go by an anti-join; the other hits of
    such an hour are written again beside them, all other hours stay as they are. An address both added and removed is on the list.
    """
    old = store.watchlist.select("termination_media_ip").distinct()
    wanted = added.select("termination_media_ip").distinct()
    gone = removed.select("termination_media_ip").distinct().join(wanted, "termination_media_ip", "left_anti")
    gone = written(old.join(gone, "termination_media_ip", "left_semi"), "watchlist")
    fresh = written(wanted.join(old, "termination_media_ip", "left_anti"), "watchlist")
    listed = written(old.join(gone, "termination_media_ip", "left_anti").unionByName(fresh), "watchlist")
    hits = store.hits
    found = written(watch_hits(store.media, fresh), "hits")
    lost = written(hits.join(gone, "termination_media_ip", "left_semi").select(*PARTITIONS).distinct(), "hits")
    touched = lost.unionByName(found.select(*PARTITIONS)).distinct()
    kept = hits.join(touched, list(PARTITIONS), "left_semi").join(gone, "termination_media_ip", "left_anti")
    again = written(kept.unionByName(found.select(*hits.columns)), "hits")
    # Hours of a changed list: at most the stored hours, a row each.
    emptied = sorted(map(tuple, lost.join(again, list(PARTITIONS), "left_anti").collect()))
    with store.change() as to:
        to.put_watchlist(listed)
        to.drop_hours("hits", emptied)
        to.replace_hours("hits", again)


def _observed(seen: Observation, name: str):
    """An observed value, or None when no row passed the observed plan at all."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return None


def _load(store: CallStore, accepted: DataFrame, hours: list[tuple], now: datetime) -> DataFrame:
    """Replace the hours of the accepted files, in all tables with one change, and return the counts per file."""
    with store.change() as to:
        return _load_into(to, accepted, hours, now)


def _load_into(store: CallStore, accepted: DataFrame, hours: list[tuple], now: datetime) -> DataFrame:
    spark = store.spark
    seen = Observation()
    # Looked at before the cells are typed: broken records go no further, and the steps after this one are not held apart by it.
    cells = src.read_cells(spark, accepted).observe(
        seen,
        # At most the paths of one job.
        F.collect_set(F.when(F.col("malformed"), F.col("file_path"))).alias("malformed"),
        F.count(F.lit(1)).alias("lines"),
    )
    records = with_partitions(src.typed_records(cells.where(~F.col("malformed")), now))
    with small_methods(spark):
        store.replace_hours("records", records)

    # Counted per fingerprint: an hour without new rows still holds its old ones.
    fingerprint = ["file_path", "source_size", "source_mtime_ms"]
    kept = (
        store.read_hours("records", hours).groupBy(*fingerprint).agg(
            F.count(F.lit(1)).alias("rows_ingested"),
            F.count(F.when(F.col("bad_cells") > 0, 1)).alias("bad_cell_rows"),
        )
    )
    counts = accepted.select(*fingerprint, *_HOUR).join(kept, fingerprint, "left")
    malformed = _observed(seen, "malformed")
    if malformed is None or len(malformed):
        # Only then is a second look at the text worth its price, and only at these files. The reader wants
        # a data column next to its marker, hence the length.
        damaged = accepted if malformed is None else accepted.where(F.col("file_path").isin(list(malformed)))
        broken = src.read_cells(spark, damaged).where("malformed AND length(sip_code) >= 0").groupBy("file_path").agg(F.count(F.lit(1)).alias("malformed_rows"))
        counts = counts.join(broken, "file_path", "left")
    else:
        counts = counts.withColumn("malformed_rows", F.lit(0).cast("long"))
    counts = written(counts.fillna(0, ["rows_ingested", "bad_cell_rows", "malformed_rows"]), "counts")

    filled = counts.groupBy(*_HOUR).agg(F.sum("rows_ingested").alias("n")).where("n = 0")
    empty = _hours(filled)
    for table in ("records", "media", "reasons", "hits"):
        store.drop_hours(table, empty)
    derive_hours(store, [h for h in hours if h not in set(empty)])
    return counts


def ingest_files(
    store: CallStore, files: DataFrame, now: datetime, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Run one cycle over discovered files and return one status row per file.

    Status is ingested, recovered, skipped, changed, error or waiting (left for
    the next cycle). The ``done`` line of the log is written last: a cycle that
    dies earlier is simply run again and replaces the same partitions.
    """
    pin_utc(store.spark)
    manifest = store.manifest
    plan = plan_cycle(store, files, options.on_change)

    actions = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    base = ["file_path", *_HOUR, "source_size", "source_mtime_ms"]
    if "ingest" in actions:
        chosen = written(src.with_headers(_chosen(plan, options.max_files, options.max_bytes)), "headers")
    else:
        chosen = plan.where("action = 'ingest'").withColumns({
            "header": F.lit(None).cast("array<string>"), "header_error": F.lit(None).cast("string"),
        })
    accepted = chosen.where(F.col("header_error").isNull())
    zero = F.lit(0).cast("long")
    refused = F.col("header_error").isNotNull()
    opened = chosen.select(
        *base, zero.alias("rows_ingested"),
        F.coalesce("header_error", F.lit("header-ok")).alias("message"),
        F.when(refused, "error").otherwise("ingesting").alias("status"),
    )
    settled = plan.where(F.col("action").isin("changed", "recover", "upgrade")).select(
        *base, "rows_ingested", "message",
        F.when(F.col("action") == "changed", "changed").otherwise("done").alias("status"),
    )
    if set(actions) - {"skip"}:
        manifest.append(settled.unionByName(opened), now, seq=1)
    if "recover" in actions:
        derive_hours(store, _hours(plan.where("action = 'recover'")))

    done = None
    if "ingest" in actions and (hours := _hours(accepted)):
        done = _load(store, accepted, hours, now)
        manifest.append(
            done.withColumns({"status": F.lit("done"), "message": F.lit("complete")}), now, seq=2
        )
    return _outcome(plan, chosen, done)


def ingest_turns(
    store: CallStore, files: DataFrame, now: datetime, options: IngestOptions = IngestOptions()
) -> list[DataFrame]:
    """Jobs of at most ``max_files`` files or ``max_bytes`` until each file had its turn; one outcome per job.

    A turn goes on with the hours the one before left waiting, whole hours as
    ever, so a refused file is tried once and holds nothing up.
    """
    outcomes = []
    while True:
        outcome = ingest_files(store, files, now + timedelta(milliseconds=len(outcomes)), options)
        outcomes.append(outcome)
        waiting = written(outcome.where("status = 'waiting'").select(*_HOUR).distinct(), "waiting")
        if waiting.isEmpty():
            return outcomes
        files = written(files.join(waiting, list(_HOUR), "left_semi"), "waiting")


def ingest_all(
    store: CallStore, files: DataFrame, now: datetime, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """All turns, as one status row per file."""
    return reduce(DataFrame.unionByName, ingest_turns(store, files, now, options)).where("status <> 'waiting'")


def _chosen(plan: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """The oldest files to load, with every other file of their hours: an hour is
    replaced as a whole."""
    order = ["file_hour", "entity", "file_path"]
    oldest = plan.where("action = 'ingest'").orderBy(*order).limit(max_files)
    # At most ``max_files`` rows. The first file is taken whatever its size.
    before = F.coalesce(F.sum("source_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    oldest = oldest.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") < max_bytes))
    return plan.join(oldest.select(*_HOUR).distinct(), list(_HOUR), "left_semi")


def _outcome(plan: DataFrame, chosen: DataFrame, done: DataFrame | None) -> DataFrame:
    words = {
        "skip": "skipped", "upgrade": "skipped", "changed": "changed", "recover": "recovered", "ingest": "waiting",
    }
    named = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col("action")]
    headers = chosen.select("file_path", "header_error", F.lit(True).alias("chosen"))
    rows = plan.join(headers, "file_path", "left")
    if done is None:
        rows = rows.withColumn("loaded_rows", F.lit(0).cast("long"))
    else:
        rows = rows.join(
            done.select("file_path", F.col("rows_ingested").alias("loaded_rows")), "file_path", "left"
        )
    status = (
        F.when(F.col("header_error").isNotNull(), "error")
        .when(F.col("chosen"), "ingested")
        .otherwise(named)
    )
    final_rows = F.when(status == "ingested", F.coalesce("loaded_rows", F.lit(0).cast("long")))
    return rows.select(
        "file_path", *_HOUR, status.alias("status"),
        F.coalesce(final_rows, F.when(status != "error", F.col("rows_ingested")), F.lit(0)).alias("rows"),
        F.coalesce("header_error", "message").alias("message"),
    )


def ingest_cycle(
    store: CallStore, landing: Landing, now: datetime, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Discover, decide and load; more than ``max_files`` files or ``max_bytes`` take several jobs."""
    files = src.discover(store.spark, landing, now, options.lookback_days, options.min_age_seconds)
    return ingest_all(store, files, now, options)


def cycle_summary(outcome: DataFrame) -> DataFrame:
    """Files and rows per status of one cycle."""
    return outcome.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")
    )


def backfill(
    store: CallStore, landing: Landing, now: datetime, days: int | None = RETENTION_DAYS,
    options: IngestOptions = IngestOptions(min_age_seconds=0),
) -> list[DataFrame]:
    """Load the last ``days`` days; the outcome of every job."""
    return ingest_turns(store, src.discover(store.spark, landing, now, days, options.min_age_seconds), now, options)


def nightly(store: CallStore, landing: Landing, now: datetime) -> DataFrame:
    """Append what is new, then drop what is older than the retention window."""
    options = IngestOptions(lookback_days=RETENTION_DAYS, min_age_seconds=120)
    outcome = ingest_cycle(store, landing, now, options)
    midnight = datetime(now.year, now.month, now.day)
    store.drop_before(midnight - timedelta(days=RETENTION_DAYS))
    return outcome


def pending(store: CallStore, files: DataFrame) -> DataFrame:
    """Discovered files that are not loaded with their present fingerprint."""
    return files.join(already_loaded(files, store.manifest.latest), "file_path", "left_anti")


def write_cold_store(files: DataFrame, path: str, now: datetime, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Convert source files to a cold Parquet tree, hour by hour, and say what happened.

    Hours already present are skipped, and so are files that were refused with their present fingerprint; beyond
    ``max_files`` or ``max_bytes`` (oldest first) files wait for another call. Same columns as the hot store; zstd, row groups of
    200 000 rows; the commit protocol makes each run all or nothing.
    """
    spark = files.sparkSession
    # The marker lists finished hours, including those whose files held no row.
    marker, schema = f"{path}/_hours", "entity string, file_hour timestamp"
    present = (
        spark.read.schema(schema).parquet(marker) if Folder(spark).exists(marker)
        else spark.createDataFrame([], schema)
    )
    refusals, fault = f"{path}/_refused", "file_path string, source_size long, source_mtime_ms long, refused string"
    refused = (
        spark.read.schema(fault).parquet(refusals) if Folder(spark).exists(refusals) else spark.createDataFrame([], fault)
    )
    known = files.select(*src.FILE_COLUMNS).join(
        present.distinct().withColumn("present", F.lit(True)), list(_HOUR), "left"
    ).join(refused.distinct(), ["file_path", "source_size", "source_mtime_ms"], "left")
    action = F.when(F.col("present"), "skip").when(F.col("refused").isNotNull(), "refused").otherwise("ingest")
    plan = written(known.withColumn("action", action), "cold-plan")
    chosen = written(src.with_headers(_chosen(plan, max_files, max_bytes).where("action = 'ingest'")), "cold")
    fresh = chosen.where(F.col("header_error").isNull())
    # Noted, so that a file nobody can read is not the oldest waiting one for ever.
    chosen.where(F.col("header_error").isNotNull()).select(
        "file_path", "source_size", "source_mtime_ms", F.col("header_error").alias("refused")
    ).write.mode("append").parquet(refusals)
    if fresh.limit(1).count():
        typed = src.typed_records(src.read_cells(spark, fresh), now)
        rows = with_partitions(typed.where(~F.col("malformed")).drop("malformed"))
        with small_methods(spark):
            write_hours(rows, f"{path}/hours", ["event_time"])
        fresh.select(*_HOUR).distinct().coalesce(1).write.mode("append").parquet(marker)
    taken = chosen.select("file_path", "header_error", F.lit(True).alias("taken"))
    fault = F.coalesce("header_error", "refused")
    status = (
        F.when(F.col("present"), "skip").when(fault.isNotNull(), "error")
        .when(F.col("taken"), "ok").otherwise("waiting")
    )
    return plan.join(taken, "file_path", "left").select("file_path", *_HOUR, status.alias("status"), fault.alias("message"))
