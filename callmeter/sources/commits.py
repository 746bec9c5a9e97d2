"""A store whose tables change together: versioned hour folders and a log of commits.

Every change writes the hours it replaces into folders of its own version, ``<table>/version=V/entity=…/file_date=…``, in as many tables
as it touches; the hour is a sorted column, so a load of many small hours makes few files and a large hour still many. Nothing stored is overwritten. The change becomes visible with one write at the end, the commit, which lists the hours
it replaced in each table. A reader resolves one commit when its plan is built, and takes of every hour the newest version up to it: records, both
rollups and hits of an hour are always of one load, before, during and after a replacement. A change that dies leaves folders no commit
names; they are never read, and ``vacuum`` removes them.

The commit also keeps, for each hour, the rows and the range of event hours (a zone map), so that readers by event time open only the hours
that can hold such events.

One change at a time: of two that start from the same commit, the second one to end finds its commit taken and fails, with no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmeter.operators.versions import latest_version
from callmeter.runtime import Folder, shuffles_dropped
from callmeter.schema import PARTITIONS, WATCHLIST_SCHEMA
from callmeter.sources.store import _SCHEMAS, _SORTED_BY, CallStore

WATCHLIST = "watchlist"
ROW_GROUP_ROWS = 200_000
# Rows of one slice of a copied table (whole hours): what is shuffled at a time.
COPY_ROWS = 10_000_000
_EVENT = {"records": "event_time", "media": "hour", "reasons": "hour", "hits": "hour"}
# Columns whose values hardly repeat by what they are: a dictionary of them is built, then given up.
UNREPEATED = {"record_key", "cdr_uuid", "callid"}
# One line per table and hour a commit replaced; ``rows`` is 0 where the hour is gone.
COMMIT_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("file_date", T.DateType()),
    T.StructField("file_hh", T.IntegerType()), T.StructField("rows", T.LongType()),
    T.StructField("first_event", T.TimestampType()), T.StructField("last_event", T.TimestampType()),
])
_HOUR_SCHEMA = "entity string, file_date date, file_hh int"


class CommitTaken(RuntimeError):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class VersionedStore(CallStore):
    """``at`` pins a commit (None: the newest at the time of each read); ``pending`` is the version a change writes."""

    at: int | None = None
    pending: int | None = None
    dropped: dict = field(default_factory=dict, compare=False)
    written: dict = field(default_factory=dict, compare=False)

    # --- the log --------------------------------------------------------------

    @property
    def _log(self) -> str:
        return f"{self.root}/commits"

    def _numbers(self, path: str, prefix: str) -> list[int]:
        return [int(n.split("=")[1]) for n in Folder(self.spark).children(path) if n.startswith(prefix)]

    def head(self) -> int:
        """The newest commit (0: none yet), or the pinned one."""
        return self.at if self.at is not None else max(self._numbers(self._log, "commit="), default=0)

    def pinned(self) -> "VersionedStore":
        """A reader that goes on seeing the present commit."""
        return replace(self, at=self.head())

    def commits(self) -> DataFrame:
        """All lines up to the reader's commit, with their ``version``."""
        head = self.head()
        if not head:
            return self.spark.createDataFrame([], T.StructType([*COMMIT_SCHEMA, T.StructField("version", T.LongType())]))
        lines = self.spark.read.schema(T.StructType([*COMMIT_SCHEMA, T.StructField("commit", T.LongType())])).parquet(self._log)
        return lines.where(F.col("commit") <= head).withColumnRenamed("commit", "version")

    def live(self, table: str) -> DataFrame:
        """The version of every stored hour of a table: one small row per hour, whatever its calls."""
        newest = latest_version(self.commits().where(F.col("table") == table), list(PARTITIONS), ["version"])
        return newest.where("rows > 0").drop("table")

    # --- reading ----------------------------------------------------------------

    def _version_folder(self, table: str, version: int) -> str:
        return f"{self.path(table)}/version={version}"

    def _files(self, table: str) -> DataFrame:
        schema = T.StructType([*_SCHEMAS[table], T.StructField("version", T.LongType())])
        return self.spark.read.schema(schema).parquet(self.path(table))

    def _of_hours(self, table: str, live: DataFrame) -> DataFrame:
        """Rows of the hours in ``live``. The join on partition columns prunes folders at run time, the span of days and versions already in the plan.

        ``live`` has one row of some 40 bytes per stored hour, so a million of them may be broadcast; AQE decides beyond.
        """
        place, bounds = [*PARTITIONS, "version"], ("file_date", "version", "file_hh")
        span = live.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in bounds for f in (F.min, F.max)], F.count("*").alias("n")).first()
        if not span["n"]:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        chosen = live.select(*place)
        chosen = F.broadcast(chosen) if span["n"] <= 1_000_000 else chosen
        one_day = span["min_file_date"] == span["max_file_date"]
        near = reduce(and_, [F.col(c).between(F.lit(span[f"min_{c}"]), F.lit(span[f"max_{c}"])) for c in (bounds if one_day else bounds[:2])])
        return self._files(table).where(near).join(chosen, place, "left_semi").select(*_SCHEMAS[table].names)

    def read(self, table: str) -> DataFrame:
        return self._of_hours(table, self.live(table))

    def read_events(self, table: str, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
        """Rows with event hours from ``first`` to ``last``, both included; only hours whose zone meets the range are opened."""
        live, event = self.live(table), F.date_trunc("hour", _EVENT[table])
        for bound, zone, condition in ((first, "last_event", lambda c, b: c >= b), (last, "first_event", lambda c, b: c <= b)):
            if bound is not None:
                live = live.where(condition(F.col(zone), F.lit(bound.isoformat(" ")).cast("timestamp")))
        rows = self._of_hours(table, live)
        if first is not None:
            rows = rows.where(event >= F.lit(first.isoformat(" ")).cast("timestamp"))
        if last is not None:
            rows = rows.where(event <= F.lit(last.isoformat(" ")).cast("timestamp"))
        return rows

    def read_hours(self, table: str, hours: list[tuple[str, date, int]]) -> DataFrame:
        """Only the given source hours. Inside a change, hours it has written come from there."""
        if not hours:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        gone, own = self.dropped.get(table, set()), self.written.get(table, {})
        old = [h for h in hours if h not in own and h not in gone]
        parts = []
        if old:
            wanted = self.spark.createDataFrame(old, _HOUR_SCHEMA)
            parts.append(self._of_hours(table, self.live(table).join(F.broadcast(wanted), list(PARTITIONS), "left_semi")))
        if new := [h for h in hours if h in own]:
            # At most the hours of one load.
            wanted = self.spark.createDataFrame(new, _HOUR_SCHEMA)
            rows = self.spark.read.schema(_SCHEMAS[table]).parquet(self._version_folder(table, self.pending))
            parts.append(rows.join(F.broadcast(wanted), list(PARTITIONS), "left_semi").select(*_SCHEMAS[table].names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _SCHEMAS[table])

    @property
    def watchlist(self) -> DataFrame:
        if self.pending is not None and self.dropped.get(WATCHLIST):
            return self.spark.read.schema(WATCHLIST_SCHEMA).parquet(self._version_folder(WATCHLIST, self.pending))
        version = self.commits().where(F.col("table") == WATCHLIST).agg(F.max("version")).first()[0]
        if version is None:
            return self.spark.createDataFrame([], WATCHLIST_SCHEMA)
        return self.spark.read.schema(WATCHLIST_SCHEMA).parquet(self._version_folder(WATCHLIST, version))

    def has_watchlist(self) -> bool:
        return bool(self.dropped.get(WATCHLIST)) or not self.commits().where(F.col("table") == WATCHLIST).isEmpty()

    # --- changing -----------------------------------------------------------------

    @contextmanager
    def change(self) -> Iterator["VersionedStore"]:
        """A store to write to; all it wrote becomes visible when the block ends without an error."""
        if self.pending is not None:
            yield self
            return
        base = self.head()
        taken = [v for table in (*_SCHEMAS, WATCHLIST) for v in self._numbers(self.path(table), "version=")]
        writer = replace(self, at=base, pending=max([base, *taken]) + 1, dropped={}, written={})
        yield writer
        writer._commit(base)

    def replace_hours(self, table: str, rows: DataFrame) -> None:
        """Put ``rows`` in place of the source hours they belong to; within one change an hour of a table is written once."""
        with self.change() as to:
            to._write(table, rows.select(*_SCHEMAS[table].names))

    def drop_hours(self, table: str, hours: list[tuple[str, date, int]]) -> None:
        with self.change() as to:
            to.dropped.setdefault(table, set()).update(tuple(h) for h in hours)

    def drop_all(self, table: str) -> None:
        with self.change() as to:
            to.dropped[table] = _Everything()

    def put_watchlist(self, addresses: DataFrame) -> None:
        with self.change() as to:
            addresses.write.mode("overwrite").parquet(to._version_folder(WATCHLIST, to.pending))
            to.dropped[WATCHLIST] = {True}

    def copy_table(self, table: str, source: "VersionedStore", most_rows: int = COPY_ROWS) -> None:
        """Put all hours of another store's table in place of the own ones, oldest first, in slices of whole hours of about ``most_rows`` rows."""
        # One commit of the source, looked at once: a small row per stored hour.
        of = source if source.pending is not None else source.pinned()
        live = of.live(table).withColumns({f"{at}_us": F.unix_micros(f"{at}_event") for at in ("first", "last")})
        lines, slices, held = live.orderBy("file_date", "file_hh", "entity").collect(), [], most_rows
        for line in lines:
            if held >= most_rows:
                slices.append([])
                held = 0
            slices[-1].append(line)
            held += line["rows"]
        with self.change() as to:
            known = to.written.setdefault(table, {})
            for part in slices:
                noted = {tuple(r[p] for p in PARTITIONS): (r["rows"], r["first_us"], r["last_us"]) for r in part}
                if known.keys() & noted.keys():
                    raise ValueError(f"an hour of {table} is written twice in one change")
                to._put(table, of._of_hours(table, self.spark.createDataFrame(part, live.schema)))
                # The source's commit has counted these hours already.
                known.update(noted)

    def _write(self, table: str, rows: DataFrame) -> None:
        path, known = self._version_folder(table, self.pending), self.written.setdefault(table, {})
        if known and known.keys() & set(map(tuple, rows.select(*PARTITIONS).distinct().collect())):
            raise ValueError(f"an hour of {table} is written twice in one change")
        self._put(table, rows)
        # One look at what was written, a small row per hour, serves this change's reads and the commit.
        event = F.unix_micros(F.date_trunc("hour", _EVENT[table]))
        stored = self.spark.read.schema(_SCHEMAS[table]).parquet(path).groupBy(*PARTITIONS).agg(F.count("*"), F.min(event), F.max(event))
        known.update({tuple(r[:3]): tuple(r[3:]) for r in stored.collect()})

    def _put(self, table: str, rows: DataFrame) -> None:
        writer = (
            # By folder, not by hour: a task that holds hours of every day would write a file in every folder.
            rows.hint("rebalance", *PARTITIONS[:2]).sortWithinPartitions(*PARTITIONS, *_SORTED_BY[table])
            .write.mode("append").option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        )
        for name in UNREPEATED.intersection(rows.columns):
            writer = writer.option(f"parquet.enable.dictionary#{name}", False)
        with shuffles_dropped(self.spark):
            writer.partitionBy(*PARTITIONS[:2]).parquet(self._version_folder(table, self.pending))

    def _written(self, table: str) -> DataFrame:
        """Commit lines of the hours this change has written: their rows and event hours."""
        lines = self.spark.createDataFrame([(*hour, *counted) for hour, counted in self.written[table].items()], f"{_HOUR_SCHEMA}, rows long, first_us long, last_us long")
        span = {f"{at}_event": F.timestamp_micros(f"{at}_us") for at in ("first", "last")}
        return lines.withColumns(span | {"table": F.lit(table)}).drop("first_us", "last_us")

    def _gone(self, table: str) -> DataFrame:
        nothing = F.lit(None).cast("timestamp")
        hours = self.dropped[table]
        if isinstance(hours, _Everything):
            places = self.live(table).select(*PARTITIONS)
        elif isinstance(hours, DataFrame):
            places = hours
        else:
            places = self.spark.createDataFrame(sorted(hours), _HOUR_SCHEMA)
        return places.select(*PARTITIONS, F.lit(0).cast("long").alias("rows"), nothing.alias("first_event"), nothing.alias("last_event"), F.lit(table).alias("table"))

    def _commit(self, base: int) -> None:
        lines = []
        for table in _SCHEMAS:
            written = self._written(table) if self.written.get(table) else None
            if written is not None:
                lines.append(written)
            if self.dropped.get(table):
                gone = self._gone(table)
                lines.append(gone.join(written, list(PARTITIONS), "left_anti") if written is not None else gone)
        if self.dropped.get(WATCHLIST):
            none = {f.name: F.lit(None).cast(f.dataType) for f in COMMIT_SCHEMA}
            lines.append(self.spark.range(1).select(*[e.alias(n) for n, e in (none | {"table": F.lit(WATCHLIST), "rows": F.lit(1).cast("long")}).items()]))
        if not lines:
            return
        if max(self._numbers(self._log, "commit="), default=0) != base:
            raise CommitTaken(f"commit after {base} is taken")
        shaped = reduce(DataFrame.unionByName, [x.select(*COMMIT_SCHEMA.names) for x in lines])
        shaped.write.mode("errorifexists").parquet(f"{self._log}/commit={self.pending}")

    # --- retention ------------------------------------------------------------------

    def drop_before(self, cutoff: datetime) -> list[str]:
        """Take whole source hours before ``cutoff`` out of every table with one commit, then remove what no commit names."""
        day, hour = F.lit(cutoff.date()), cutoff.hour
        old: Column = (F.col("file_date") < day) | ((F.col("file_date") == day) & (F.col("file_hh") < hour))
        with self.change() as to:
            for table in _SCHEMAS:
                to.dropped[table] = self.live(table).where(old).select(*PARTITIONS)
        return self.vacuum()

    def vacuum(self) -> list[str]:
        """Remove folders of which the newest commit names no hour. Readers pinned to an older commit must be done; no change may be under way."""
        folder, removed = Folder(self.spark), []
        for table in _SCHEMAS:
            named = {tuple(r) for r in self.live(table).select("version", "entity", "file_date").distinct().toLocalIterator()}
            versions = {n[0] for n in named}
            for version in self._numbers(self.path(table), "version="):
                root = self._version_folder(table, version)
                if version not in versions:
                    removed.append(root)
                    folder.drop(root)
                    continue
                for entity, day in ((e, d) for e in folder.children(root) if e.startswith("entity=") for d in folder.children(f"{root}/{e}")):
                    if (version, entity[7:], date.fromisoformat(day[10:])) not in named:
                        removed.append(f"{root}/{entity}/{day}")
                        folder.drop(removed[-1])
        lists = self._numbers(self.path(WATCHLIST), "version=")
        present = self.commits().where(F.col("table") == WATCHLIST).agg(F.max("version")).first()[0]
        for version in lists:
            if version != present:
                removed.append(self._version_folder(WATCHLIST, version))
                folder.drop(removed[-1])
        return removed


class _Everything:
    """All hours of a table."""

    def __contains__(self, hour) -> bool:
        return True
