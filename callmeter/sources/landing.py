"""Hourly source files: discovery, header contract, typed reading."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmeter.functions.parsing import best_effort_float, best_effort_timestamp, best_effort_uint
from callmeter.runtime import few_listers, written
from callmeter.schema import RECORD_COLUMNS, REQUIRED_HEADERS, SOURCE_COLUMNS, UINT_BITS

MIN_AGE_SECONDS = 600
LOOKBACK_DAYS = 2

# ``entity/YYYY/MM/DD/HH.csv.gz`` at the end of a path: one file per source hour.
HOUR_FILE = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})\.csv\.gz$"
# The same hour written as a folder of part files by a distributed writer.
HOUR_FOLDER = r"entity=([^/]+)/y=(\d{4})/m=(\d{2})/d=(\d{2})/h=(\d{2})/part-[^/]*\.csv\.gz$"

_CORRUPT = "_corrupt_record"
# Compressed bytes from which the files of one width are scanned by themselves, and the most such scans of a job.
OWN_SCAN_BYTES, MOST_SCANS = 4 << 20, 16
ORIGIN = ["entity", "file_hour", "source_size", "source_mtime_ms"]
FILE_COLUMNS = ["file_path", "entity", "file_hour", "source_size", "source_mtime_ms", "modified_at"]


@dataclass(frozen=True)
class Landing:
    """Where source files arrive, who sends them, and what their paths look like."""

    root: str
    entities: tuple[str, ...]
    pattern: str = HOUR_FILE


# --- discovery -------------------------------------------------------------------

def path_parts(files: DataFrame, landing: Landing) -> DataFrame:
    """Entity and source hour of every path; both NULL where the path is not canonical.

    The pattern is anchored at the landing root, so depth counts; the entity must
    be known, the date real and the hour below 24.
    """
    root = landing.root.rstrip("/")
    bare = re.escape(re.sub(r"^[a-z0-9]+:/+", "/", root))
    anchored = f"{bare}/{landing.pattern}"

    def part(i: int):
        return F.regexp_extract("file_path", anchored, i)

    day = F.try_to_timestamp(F.concat_ws("-", part(2), part(3), part(4)), F.lit("yyyy-MM-dd"))
    hour = part(5).try_cast("int")
    valid = part(1).isin(*landing.entities) & day.isNotNull() & hour.between(0, 23)
    return files.withColumns({
        "entity": F.when(valid, part(1)),
        "file_hour": F.when(valid, F.timestamp_seconds(F.unix_timestamp(day) + hour * 3600)),
    })


def plain_path(path):
    """One spelling for local paths, which listings and scans write differently. Only paths in another one meet the pattern."""
    path = F.col(path) if isinstance(path, str) else path
    settled = ~F.startswith(path, F.lit("file:/")) | (F.startswith(path, F.lit("file:///")) & ~F.startswith(path, F.lit("file:////")))
    return F.when(settled, path).otherwise(F.regexp_replace(path, "^file:/+", "file:///"))


def listing(spark: SparkSession, paths) -> DataFrame:
    """Path, size and modification time of files (their content is never read)."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz")
        .load(paths)
    )
    return found.select(
        plain_path(F.col("path")).alias("file_path"),
        F.col("length").alias("source_size"),
        F.unix_millis("modificationTime").alias("source_mtime_ms"),
        F.col("modificationTime").alias("modified_at"),
    )


def canonical_files(files: DataFrame, landing: Landing) -> DataFrame:
    """Listed files whose path names a known entity and a real hour."""
    return path_parts(files, landing).where(F.col("entity").isNotNull()).select(*FILE_COLUMNS)


def stable_files(
    files: DataFrame, now: datetime, lookback_days: int | None = LOOKBACK_DAYS,
    min_age_seconds: int = MIN_AGE_SECONDS,
) -> DataFrame:
    """Files of the last days that nobody is writing any more, oldest hour first."""
    chosen = files.where(~too_young(now, min_age_seconds))
    if lookback_days is not None:
        first = (now - timedelta(days=max(1, lookback_days) - 1)).date()
        chosen = chosen.where(F.to_date("file_hour").between(F.lit(first), F.lit(now.date())))
    return chosen.orderBy("file_hour", "entity", "file_path")


def too_young(now: datetime, min_age_seconds: int = MIN_AGE_SECONDS):
    newest = F.lit((now - timedelta(seconds=min_age_seconds)).isoformat(" ")).cast("timestamp")
    return F.col("modified_at") > newest


def discover(
    spark: SparkSession, landing: Landing, now: datetime,
    lookback_days: int | None = LOOKBACK_DAYS, min_age_seconds: int = MIN_AGE_SECONDS,
) -> DataFrame:
    """Stable canonical files below the landing root."""
    files = canonical_files(listing(spark, landing.root), landing)
    return stable_files(files, now, lookback_days, min_age_seconds)


# --- header contract ----------------------------------------------------------------

_HEADER_SCHEMA = "file_path string, header array<string>, header_error string"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _first_line(path: str) -> str:
    """Decompress just enough of one file to see its header."""
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    with filesystem.open_input_stream(inner, compression="gzip") as stream:
        text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
        row = next(csv.reader(text), None)
    return [name.strip() for name in row] if row else []


def _header_fault(names: list[str]) -> str | None:
    """All breaches of the column contract, or None."""
    breaches = {
        "repeated": [n for n, times in Counter(names).items() if times > 1],
        "malformed": [n for n in dict.fromkeys(names) if not _NAME.fullmatch(n)],
        "absent": [n for n in REQUIRED_HEADERS if n not in names],
    }
    told = [f"{kind} columns: {', '.join(map(repr, found))}" for kind, found in breaches.items() if found]
    return "; ".join(told) or None


def _peek(batches):
    for batch in batches:
        out = []
        for path in batch["file_path"]:
            try:
                names = _first_line(path)
                fault = _header_fault(names)
            except Exception as exc:  # an unreadable file is refused, not fatal
                names, fault = [], f"unreadable file: {exc}"[:1000]
            out.append((path, names, fault))
        yield pd.DataFrame(out, columns=["file_path", "header", "header_error"])


def with_headers(files: DataFrame) -> DataFrame:
    """Add ``header`` and ``header_error`` to each file; headers are read on executors."""
    workers = files.sparkSession.sparkContext.defaultParallelism
    peeked = files.select("file_path").repartition(workers, "file_path").mapInPandas(_peek, _HEADER_SCHEMA)
    return files.join(peeked, "file_path", "left")


# --- reading ---------------------------------------------------------------------------

def _cell_count(raw: Column) -> Column:
    """Cells of one raw record: separators outside quotes, and one more."""
    bare = F.regexp_replace(raw, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _scan(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    """Path as the scan spells it, text cells and number of cells of every record of some files, read as records of ``width`` cells."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(schema)
        .option("header", True).option("escape", '"').option("multiLine", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        .option("columnPruning", False)
    )
    with few_listers(spark):
        scan = reader.csv(sorted(paths))
    return scan.select(
        # The metadata column would copy every record once more.
        F.input_file_name().alias("spelled"),
        F.array(*[f"c{i}" for i in range(width)]).alias("cells"),
        F.coalesce(_cell_count(F.col(_CORRUPT)), F.lit(width)).alias("found"),
    )


def _spellings(scans: list[DataFrame]) -> DataFrame:
    """How the scans spell the paths of their files (URL-encoded), next to the plain ones of listings: a row per file of the job."""
    pairs = [(p, re.sub("^file:/+", "file:///", unquote(p))) for scan in scans for p in scan.inputFiles()]
    return scans[0].sparkSession.createDataFrame(pairs, "spelled string, file_path string")


def _scans(listed: list[Row]) -> list[tuple[int, list[str]]]:
    """Width and paths of each scan: a scan of their own for files of one width that hold much text, one as wide as the widest header for
    all others. To the reader a record that is not as wide as its scan is an exception, which costs more than its cells."""
    by_width: dict[int, list[Row]] = {}
    for r in listed:
        by_width.setdefault(r["width"], []).append(r)
    large = sorted(by_width, key=lambda w: -sum(r["source_size"] for r in by_width[w]))[:MOST_SCANS]
    own = [w for w in large if sum(r["source_size"] for r in by_width[w]) >= OWN_SCAN_BYTES]
    rest = [r for w, rows in by_width.items() if w not in own for r in rows]
    scans = [(w, [r["file_path"] for r in by_width[w]]) for w in own]
    return scans + ([(max(r["width"] for r in rest), [r["file_path"] for r in rest])] if rest else [])


def read_cells(spark: SparkSession, accepted: DataFrame) -> DataFrame:
    """Text cells of all accepted files by column name, with the provenance of their file, in one job whatever their headers.

    A scan binds by position. Each file's header says at which position a
    known column stands, and a join with that small table (one row per file of the job, which
    the caller keeps short) picks the cells and supplies the provenance: every join and step copies the whole record. That table knows each
    file's path as the scan spells it, so no record has its own made plain. Absent known columns come as ``''``. A record whose number
    of cells is not that of its own header is marked ``malformed``: the reader reports every record that is not as wide as its scan, and
    those are counted from their text. That needs every cell parsed, so the reader's own column pruning is off.
    """
    listed = accepted.select("file_path", "source_size", F.size("header").alias("width")).collect()
    scans = [_scan(spark, paths, width) for width, paths in _scans(listed)]
    cells = reduce(DataFrame.unionByName, scans)
    names = F.array(*[F.lit(n) for n in SOURCE_COLUMNS])
    places = accepted.select(
        "file_path", *ORIGIN, F.size("header").alias("width"),
        F.transform(names, lambda n: F.array_position("header", n).cast("int") - 1).alias("places"),
    )
    places = written(places.join(_spellings(scans), "file_path"), "places")
    met = cells.join(F.broadcast(places), "spelled")
    empty = F.lit("")
    known = [F.coalesce(F.get("cells", F.get("places", F.lit(i))), empty).alias(n) for i, n in enumerate(SOURCE_COLUMNS)]
    return met.select("file_path", *ORIGIN, *known, (F.col("found") != F.col("width")).alias("malformed"))


def typed_records(cells: DataFrame, ingested_at: datetime) -> DataFrame:
    """Stored records from text cells.

    Unparsable cells become NULL or zero, and ``bad_cells`` counts them. Empty
    text is stored as NULL.
    """
    parsed, stored, faults, said = {}, {}, [], []
    for name, kind in SOURCE_COLUMNS.items():
        text, read = F.col(name), F.col(f"_{name}")
        if isinstance(kind, T.StringType):
            parsed[f"_{name}"], stored[name] = F.nullif(text, F.lit("")), read
            continue
        if isinstance(kind, T.TimestampType):
            parsed[f"_{name}"], stored[name] = best_effort_timestamp(text), read
        elif name in UINT_BITS:
            parsed[f"_{name}"] = best_effort_uint(text, UINT_BITS[name])
            stored[name] = F.coalesce(read, F.lit(0).cast(kind))
        else:
            parsed[f"_{name}"], stored[name] = best_effort_float(text), F.coalesce(read, F.lit(0.0))
        # One bit for each cell that says something, in one number: a column each would be copied with every step.
        bit = 1 << len(said)
        said.append(((text != "") & (F.trim(text) != "")).cast("long") * bit)
        faults.append(((F.col("said").bitwiseAND(F.lit(bit)) != 0) & read.isNull()).cast("int"))

    keyed = ["entity", F.col("file_hour").cast("string")] + [
        "cdr_uuid", "callid", "from_did", "to_did", "call_start_time", "attempt_counter",
    ]
    # Every cell is parsed once here and looked at twice below; its text goes no further.
    read_once = cells.select("file_path", *ORIGIN, "malformed", F.xxhash64(*keyed).alias("record_key"), sum(said[1:], said[0]).alias("said"), *[e.alias(n) for n, e in parsed.items()])
    typed = read_once.select(
        "record_key", "entity", "file_hour", "file_path", "source_size", "source_mtime_ms",
        F.lit(ingested_at.isoformat(" ")).cast("timestamp").alias("ingested_at"),
        *[e.alias(n) for n, e in stored.items()],
        "malformed", sum(faults[1:], faults[0]).alias("bad_cells"),
    )
    event = F.coalesce("call_end_time", "call_start_time", "file_hour")
    return typed.withColumn("event_time", event).select(*RECORD_COLUMNS, "malformed")
