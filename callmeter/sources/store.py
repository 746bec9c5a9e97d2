"""The partitioned call-record store and its derived tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmeter.runtime import Folder, has_rows_on_disk, shuffles_dropped
from callmeter.schema import PARTITIONS, WATCHLIST_SCHEMA, record_schema
from callmeter.sources.manifest import Manifest

_STR, _LONG = T.StringType(), T.LongType()
_TAIL = [
    T.StructField("file_date", T.DateType()), T.StructField("file_hh", T.IntegerType()),
]


def _table(strings_before: list, strings: list[str], measures: list[str]) -> T.StructType:
    fields = strings_before + [T.StructField(s, _STR) for s in strings]
    fields += [T.StructField(m, _LONG) for m in measures]
    return T.StructType([*fields, T.StructField("entity", _STR), *_TAIL])


_HOUR = [T.StructField("day", T.DateType()), T.StructField("hour", T.TimestampType())]
_SIP = [T.StructField("sip_code", T.IntegerType())]
MEDIA_SCHEMA = _table(
    _HOUR + _SIP,
    ["term_media_ip", "term_ip", "term_carrier_name", "term_trunk_group_name", "orig_trunk_group_name",
     "reason", "stir_attest", "term_state", "term_ratecenter"],
    ["attempts", "completions", "billed_seconds", "revenue_units", "cost_units",
     "pdd_sum", "pdd_count", "mos_units", "mos_count"],
)
REASON_SCHEMA = _table(
    _HOUR + _SIP, ["orig_trunk_group_name", "term_state", "billed_prefix", "reason"], ["attempts"],
)
HITS_SCHEMA = _table(
    _HOUR[1:],
    ["termination_media_ip", "orig_trunk_group_name", "term_carrier_name", "term_trunk_group_name", "term_ip"],
    ["matching_cdrs"],
)

# Leading sort columns inside a partition, for row-group skipping and compression.
_SORTED_BY = {
    "records": ["term_media_ip", "term_trunk_group_name", "orig_trunk_group_name", "sip_code"],
    "media": ["hour", "term_media_ip", "term_trunk_group_name", "orig_trunk_group_name"],
    "reasons": ["hour", "orig_trunk_group_name", "term_state", "billed_prefix"],
    "hits": ["termination_media_ip", "hour"],
}
_SCHEMAS = {
    "records": record_schema(), "media": MEDIA_SCHEMA, "reasons": REASON_SCHEMA, "hits": HITS_SCHEMA,
}


def with_partitions(df: DataFrame) -> DataFrame:
    """Add the partition columns of the source hour."""
    return df.withColumns({"file_date": F.to_date("file_hour"), "file_hh": F.hour("file_hour")})


def partition_path(root: str, entity: str, day: date, hour: int) -> str:
    return f"{root}/entity={entity}/file_date={day.isoformat()}/file_hh={hour}"


@dataclass(frozen=True)
class CallStore:
    """Records, rollups, watch hits and the load log below one root folder.

    Every table is partitioned by source hour, so an hour is replaced in each of
    them by overwriting one partition.
    """

    spark: SparkSession
    root: str

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/manifest")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # --- reading ------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        """A table under its declared schema; columns older files lack read NULL."""
        schema = _SCHEMAS[table]
        if not has_rows_on_disk(self.spark, self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    @property
    def records(self) -> DataFrame:
        return self.read("records")

    @property
    def media(self) -> DataFrame:
        return self.read("media")

    @property
    def reasons(self) -> DataFrame:
        return self.read("reasons")

    @property
    def hits(self) -> DataFrame:
        return self.read("hits")

    @property
    def watchlist(self) -> DataFrame:
        if not self.has_watchlist():
            return self.spark.createDataFrame([], WATCHLIST_SCHEMA)
        return self.spark.read.schema(WATCHLIST_SCHEMA).parquet(self.path("watchlist"))

    def read_hours(self, table: str, hours: list[tuple[str, date, int]]) -> DataFrame:
        """Only the given source hours, addressed by folder (others are not even listed)."""
        root, folder = self.path(table), Folder(self.spark)
        paths = [p for p in (partition_path(root, *h) for h in hours) if folder.exists(p)]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).option("basePath", root).parquet(*paths)

    def register_views(self, prefix: str = "") -> None:
        """Temp views for ad-hoc ``spark.sql``."""
        for table in _SCHEMAS:
            self.read(table).createOrReplaceTempView(prefix + table)
        self.watchlist.createOrReplaceTempView(prefix + "watchlist")
        self.manifest.latest.createOrReplaceTempView(prefix + "manifest")

    def has_watchlist(self) -> bool:
        return has_rows_on_disk(self.spark, self.path("watchlist"))

    # --- writing ------------------------------------------------------------

    @contextmanager
    def change(self) -> Iterator["CallStore"]:
        """The writes of one load. Here each table changes by itself; see ``commits.VersionedStore`` for all at once."""
        yield self

    def put_watchlist(self, addresses: DataFrame) -> None:
        addresses.write.mode("overwrite").parquet(self.path("watchlist"))

    def drop_all(self, table: str) -> None:
        Folder(self.spark).drop(self.path(table))

    def replace_hours(self, table: str, rows: DataFrame) -> None:
        """Overwrite exactly the source hours present in ``rows``."""
        write_hours(rows.select(*_SCHEMAS[table].names), self.path(table), _SORTED_BY[table])

    def drop_hours(self, table: str, hours: list[tuple[str, date, int]]) -> None:
        folder = Folder(self.spark)
        for hour in hours:
            folder.drop(partition_path(self.path(table), *hour))

    def drop_before(self, cutoff: datetime) -> list[str]:
        """Rolling retention: remove whole source hours before ``cutoff``, and their log lines."""
        folder, dropped = Folder(self.spark), []

        def drop(path: str) -> None:
            folder.drop(path)
            dropped.append(path)

        for table in _SCHEMAS:
            root = self.path(table)
            for entity in _named(folder, root, "entity="):
                for day_dir in _named(folder, f"{root}/{entity}", "file_date="):
                    day, base = date.fromisoformat(day_dir[10:]), f"{root}/{entity}/{day_dir}"
                    if day < cutoff.date():
                        drop(base)
                    elif day == cutoff.date():
                        for hh in _named(folder, base, "file_hh="):
                            if int(hh[8:]) < cutoff.hour:
                                drop(f"{base}/{hh}")
        for day_dir in _named(folder, self.manifest.path, "file_date="):
            if date.fromisoformat(day_dir[10:]) < cutoff.date():
                drop(f"{self.manifest.path}/{day_dir}")
        return dropped

    # --- statistics -----------------------------------------------------------

    def stats(self) -> DataFrame:
        return store_stats(self.records, self.manifest.latest)


def _named(folder: Folder, path: str, prefix: str) -> list[str]:
    return [n for n in folder.children(path) if n.startswith(prefix)]


def write_hours(
    rows: DataFrame, path: str, sorted_by: list[str], compression: str = "zstd", row_group_rows: int = 200_000
) -> None:
    """Write source-hour partitions, replacing only those present.

    The rebalance hint lets AQE merge small hours and split a hot one over
    several tasks, so neither tiny files nor one giant task come out.
    """
    with shuffles_dropped(rows.sparkSession):
        (
            rows.hint("rebalance", *PARTITIONS)
            .sortWithinPartitions(*PARTITIONS, *sorted_by)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("compression", compression)
            .option("parquet.block.row.count.limit", row_group_rows)
            .partitionBy(*PARTITIONS).parquet(path)
        )


def store_stats(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows, loaded files, oldest and newest source hour, number of entities."""
    return records.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("file_hour").alias("oldest_hour"),
        F.max("file_hour").alias("newest_hour"),
        F.count_distinct("entity").alias("entity_count"),
    ).withColumn("files_ingested", manifest.agg(F.count(F.lit(1))).scalar())
