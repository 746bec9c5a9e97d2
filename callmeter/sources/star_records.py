"""Call records derived from the star-schema test tables.

Each projected column is one SQL expression valid in Spark and DuckDB once two
placeholders are filled in: ``STR`` (the string type) and ``TS(seconds)``.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callmeter.runtime import shuffles_dropped, small_methods
from callmeter.schema import AREA_CODE_SCHEMA

# Records written at a time: all lines of their hours are shuffled together.
SLICE_RECORDS = 40_000_000

STAR_ENTITIES = ("E0", "E1", "E2", "E3")
FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 30)
WATCHED = ("203.0.113.10", "203.0.113.12")

# Area codes occurring in the projection below, with their state or province.
STAR_AREA_CODES = (
    ("201", "NJ"), ("208", "ID"), ("214", "TX"), ("215", "PA"), ("227", "MD"),
    ("229", "GA"), ("236", "BC"), ("240", "MD"), ("250", "BC"), ("253", "WA"),
    ("257", "BC"), ("279", "CA"), ("306", "SK"), ("313", "MI"), ("320", "MN"),
    ("334", "AL"), ("341", "CA"),
)

_BASE = {
    "k": "l.l_orderkey*10 + l.l_linenumber",
    "pk": "l.l_partkey",
    "sk": "l.l_suppkey",
    "ck": "o.o_custkey",
    "ln": "l.l_linenumber",
    "seg": "c.c_mktsegment",
    "cn": "c.c_nationkey",
    "sn": "s.s_nationkey",
    "q": "l.l_quantity",
    "ep": "l.l_extendedprice",
    "disc": "l.l_discount",
    "ended": "1704067200 + ((l.l_orderkey*10 + l.l_linenumber)*7919) % 2592000",
    "started": "1704067200 + ((l.l_orderkey*10 + l.l_linenumber)*7919) % 2592000"
               " - 5 - CAST(l.l_quantity AS BIGINT)*6",
}
RECORD = {
    "entity": "CASE ln % 4 WHEN 0 THEN 'E0' WHEN 1 THEN 'E1' WHEN 2 THEN 'E2' ELSE 'E3' END",
    "call_end_time": "TS(ended)",
    "call_start_time": "TS(started)",
    "event_time": "TS(ended)",
    "file_hour": "date_trunc('hour', TS(ended))",
    "callid": "'call-' || CAST(k AS STR) || '-' || CAST(pk AS STR) || '-' || CAST(sk AS STR)",
    "from_did": "'1' || CAST(2000000000 + (ck*104729) % 7999999999 AS STR)",
    "to_did": "CASE WHEN sk % 10 = 0 THEN '44' ELSE '1' END"
              " || CAST(2000000000 + (k*7919) % 7999999999 AS STR)",
    "sip_code": "CAST(CASE WHEN (cn + sn) % 6 = 0 AND pk % 10 <> 9 THEN 503 WHEN pk % 10 = 0 THEN 404"
                " WHEN pk % 10 = 1 THEN 486 WHEN pk % 10 IN (2,3) THEN 503 ELSE 200 END AS INT)",
    "sip_reason": "CASE pk % 4 WHEN 0 THEN '' WHEN 1 THEN 'Busy Here'"
                  " WHEN 2 THEN 'Service Unavailable' ELSE 'OK' END",
    "reason": "CASE WHEN pk % 10 IN (2,3) THEN CASE pk % 3 WHEN 0 THEN 'NO_VENDOR_RATE'"
              " WHEN 1 THEN 'LIMITS_EXCEEDED' ELSE '' END ELSE '' END",
    "duration_real": "CAST(q*6 AS INT)",
    "pdd": "CAST((pk*31 + sk) % 4000 AS INT)",
    "orig_carrier_name": "'C' || CAST(cn AS STR)",
    "orig_trunk_group_name": "CASE WHEN ck % 23 = 0 THEN NULL ELSE seg || '-' || CAST(cn % 2 AS STR) END",
    "orig_state": "CASE ck % 5 WHEN 0 THEN 'tfree' WHEN 1 THEN ' TX ' WHEN 2 THEN '' ELSE 'CA' END",
    "orig_billed_prefix": "CASE WHEN ck % 17 = 0 THEN ' ' WHEN ck % 19 = 0 THEN NULL"
                          " WHEN cn % 4 = 0 THEN CAST(201 + cn*7 AS STR) || '555'"
                          " ELSE '1' || CAST(201 + cn*7 AS STR) || '555' END",
    "orig_billed_duration": "CAST(q*6 AS INT)",
    "orig_cost": "ep*0.0001",
    "term_carrier_name": "CASE WHEN sk % 29 = 0 THEN '' ELSE 'V' || CAST(sn AS STR) END",
    "term_trunk_group_name": "'V' || CAST(sn AS STR) || '-TG' || CAST(sk % 3 AS STR)",
    "term_ip": "'198.51.100.' || CAST(sk % 250 AS STR)",
    "term_media_ip": "CASE WHEN sk % 9 = 0 THEN '' WHEN sk % 9 = 1 THEN ' 203.0.113.10 '"
                     " ELSE '203.0.113.' || CAST(sk % 200 AS STR) END",
    "term_state": "CASE WHEN sn % 7 = 0 THEN NULL ELSE 'S' || CAST(sn % 8 AS STR) END",
    "term_ratecenter": "CASE WHEN sn % 11 = 0 THEN NULL ELSE 'RC' || CAST(sn % 8 AS STR) END",
    "term_billed_prefix": "CASE WHEN sn % 13 = 0 THEN NULL ELSE '1' || CAST(201 + (sn % 8)*13 AS STR) END",
    "term_cost": "ep*0.0001*(0.6+disc*8)",
    "stir_x5u": "CASE WHEN ck % 3 = 0 THEN '' ELSE 'https://cert.example/' || CAST(cn AS STR) || '.pem' END",
    "stir_attest": "CASE ck % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END",
    "mos_avg": "CASE WHEN pk % 6 = 0 THEN 0.0 ELSE 1.0 + (pk % 35) / 10.0 END",
}
# Expressions whose literals would be decimals in Spark.
_SPARK_ONLY = {
    "orig_cost": "ep*0.0001D",
    "term_cost": "ep*0.0001D*(0.6D+disc*8)",
    "mos_avg": "CASE WHEN pk % 6 = 0 THEN 0.0D ELSE 1.0D + (pk % 35) / 10.0D END",
}


def _render(expr: str, string_type: str, timestamp: str) -> str:
    expr = re.sub(r"\bSTR\b", string_type, expr)
    return re.sub(r"\bTS\((\w+)\)", timestamp, expr)


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Its footer is looked at once per process, not per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def star_records(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The projection as a Spark DataFrame; the small joins are left to Catalyst.

    ``lineitem`` may be a stream; the other tables are then static join sides.
    """

    def table(name: str, alias: str) -> DataFrame:
        return read_table(spark, sf_dir, name).alias(alias)

    # The narrow customer join goes first, so the wide records are shuffled once less.
    orders = table("orders", "o").join(
        table("customer", "c"), F.col("o.o_custkey") == F.col("c.c_custkey")
    )
    joined = (
        (table("lineitem", "l") if lineitem is None else lineitem.alias("l"))
        # Both sides are fact tables that grow together: never broadcast one of
        # them because it happens to be small or its size is misjudged.
        .hint("merge").join(orders, F.col("l.l_orderkey") == F.col("o.o_orderkey"))
        .join(table("supplier", "s"), F.col("l.l_suppkey") == F.col("s.s_suppkey"))
    )
    base = joined.selectExpr(*[f"{e} AS {n}" for n, e in _BASE.items()])
    texts = {n: _SPARK_ONLY.get(n, e) for n, e in RECORD.items()}
    return base.selectExpr(*[
        f"{_render(e, 'STRING', r'timestamp_seconds(\1)')} AS {n}" for n, e in texts.items()
    ])


def star_records_sql() -> str:
    """The same projection as DuckDB common table expressions ending in ``cdr``."""
    base = ", ".join(f"{e} AS {n}" for n, e in _BASE.items())
    cols = ", ".join(
        f"{_render(e, 'VARCHAR', r'make_timestamp(1000000*(\1))')} AS {n}" for n, e in RECORD.items()
    )
    return (
        f"b AS (SELECT {base} FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey), "
        f"cdr AS (SELECT {cols} FROM b)"
    )


#: An hour file nobody can load: its header lacks a required column.
REFUSED_HOUR = ("E3", "2024", "01", "31", "05")


def hour_headers() -> list[list[str]]:
    """The header of the files of each hour of the day, as senders drift apart: columns in another order every hour, in some
    hours without ``duration_real``, in some with a column that the store does not know."""
    names = [n for n in RECORD if n not in ("entity", "event_time", "file_hour")]
    out = []
    for hour in range(24):
        turned = names[hour % len(names):] + names[: hour % len(names)]
        out.append([n for n in turned if hour % 3 or n != "duration_real"] + ([] if hour % 4 else ["x_trace"]))
    return out


def hour_lines(records: DataFrame, refused: bool = True) -> DataFrame:
    """The lines of all hour files: headers as above, a broken line in every fifth hour of the day and, where wanted, one refused file. Rows
    are dealt by hour, so a file is written by one task, its header first.

    The cells of a row are worked out once, into one array, before its header's order is looked up: ``inline`` keeps the two steps
    apart, else every look-up would work out all cells again."""
    headers, place = hour_headers(), ["entity", "y", "m", "d", "h"]
    names = sorted({n for h in headers for n in h})
    spread = {"y": (1, 4), "m": (6, 2), "d": (9, 2), "h": (12, 2)}
    parts = [F.substring("stamp", *at).alias(n) for n, at in spread.items()]
    stamp, hour = F.date_format("file_hour", "yyyy-MM-dd HH").alias("stamp"), F.substring("stamp", *spread["h"]).cast("int")
    cells = F.array(*[F.lit("?") if n not in RECORD else F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    order = F.get(F.array(*[F.array(*[F.lit(names.index(n)) for n in h]) for h in headers]), hour)
    line = F.array_join(F.transform(order, lambda i: F.get("cells", i)), ",")
    made = records.select("entity", F.inline(F.array(F.struct(stamp, cells.alias("cells")))))
    rows = made.select("entity", *parts, F.lit(1).alias("place"), line.alias("line"))
    seen = records.select("entity", "file_hour").distinct().select("entity", stamp)
    head, broken = F.get(F.array(*[F.lit(",".join(h)) for h in headers]), hour), F.when(hour % 5 == 0, "200,broken")
    beside = F.array(*[F.struct(F.lit(at).alias("place"), text.alias("line")) for at, text in ((0, head), (2, broken))])
    others = seen.select("entity", "stamp", F.inline(beside)).where("place = 0 OR line IS NOT NULL").select("entity", *parts, "place", "line")
    lines = rows.unionByName(others)
    if refused:
        lines = lines.unionByName(_refused_lines(records.sparkSession))
    return lines.repartition(*place).sortWithinPartitions(*place, "place").drop("place")


def _refused_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*REFUSED_HOUR, 0, "sip_code,call_start_time,call_end_time"), (*REFUSED_HOUR, 1, "200,2024-01-31 05:00:00,2024-01-31 05:00:10")],
        "entity string, y string, m string, d string, h string, place int, line string",
    )


def slices_of(lines: int) -> int:
    """In how many slices the records of so many call lines are written."""
    return max(1, -(-lines // SLICE_RECORDS))


def write_hour_files(records: DataFrame, root: str, slices: int = 1) -> None:
    """The records as compressed text, one file per entity and source hour. With several slices, every so manieth hour is written at a
    time, so that only these lines are shuffled together; the filter goes below the joins of the records."""
    spark, hour = records.sparkSession, F.coalesce(F.unix_seconds("file_hour"), F.lit(0))
    for i in range(slices):
        # Whole hours: 3600 seconds each.
        chosen = records if slices == 1 else records.where(F.pmod(F.floor(hour / 3600), F.lit(slices)) == i)
        with small_methods(spark), shuffles_dropped(spark):
            (
                hour_lines(chosen, refused=i == 0).write.mode("append" if i else "errorifexists")
                .option("header", False).option("compression", "gzip").option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False)
                .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                .option("zlib.compress.level", "BEST_SPEED").partitionBy("entity", "y", "m", "d", "h").csv(root)
            )


def star_area_codes(spark: SparkSession) -> DataFrame:
    """Area codes of the projection; a deployment passes its own full list."""
    return spark.createDataFrame(list(STAR_AREA_CODES), AREA_CODE_SCHEMA)
