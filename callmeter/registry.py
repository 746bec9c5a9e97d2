"""Registered queries and, where SQL can say the same, their DuckDB twins.

Every query reads the given tables through the record projection in
``sources.star_records``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.functions import metrics
from callmeter.params import PanelFilter, report_params, with_hour_preset, with_table_preset
from callmeter.plans import detail, reports, rollups, snapshots, watchlist
from callmeter.runtime import pin_utc, written
from callmeter.schema import WATCHLIST_SCHEMA
from callmeter.sources.star_records import (
    FIRST_DAY, LAST_DAY, STAR_AREA_CODES, STAR_ENTITIES, WATCHED,
    read_table, star_area_codes, star_records, star_records_sql,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its DuckDB text if there is one."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_utc(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = " ".join(sql.split())
        return run

    return keep


# --- SQL building blocks of the twins -----------------------------------------------

CDR = star_records_sql()

_SCOPE = "to_did LIKE '1%' AND length(to_did) = 11"
_RATED = "coalesce(nullif(trim({}), ''), '(unrated)')"
_DIM_SQL = {
    "customer": "coalesce(orig_trunk_group_name, '(none)')",
    "code": _RATED.format("orig_billed_prefix"),
    "term_code": _RATED.format("term_billed_prefix"),
    "state": "coalesce(term_state, '?')",
    "ratecenter": "coalesce(term_ratecenter, '?')",
    "x5u_url": "coalesce(nullif(stir_x5u, ''), '(unsigned)')",
    "attest": "coalesce(nullif(stir_attest, ''), '?')",
}
# Money is exact at eight decimals on this projection.
_BLOCK = """
count(*) AS attempts,
count(*) FILTER (sip_code = 200) AS completions,
round(100.0 * count(*) FILTER (sip_code = 200) / nullif(count(*), 0), 2)::DOUBLE AS asr_pct,
round(sum(orig_billed_duration) FILTER (sip_code = 200) / 60.0, 2)::DOUBLE AS minutes,
round(sum(orig_cost::DECIMAL(18,8)), 4)::DOUBLE AS revenue,
round(sum(term_cost::DECIMAL(18,8)), 4)::DOUBLE AS cost,
round(sum(orig_cost::DECIMAL(18,8)) - sum(term_cost::DECIMAL(18,8)), 4)::DOUBLE AS margin
"""
_TOTALS = """
sum(attempts)::BIGINT AS attempts, sum(completions)::BIGINT AS completions,
round(100.0 * sum(completions) / sum(attempts), 2)::DOUBLE AS asr_pct,
sum(minutes::DECIMAL(18,2))::DOUBLE AS minutes, sum(revenue::DECIMAL(18,4))::DOUBLE AS revenue,
sum(cost::DECIMAL(18,4))::DOUBLE AS cost, sum(margin::DECIMAL(18,4))::DOUBLE AS margin
"""


def _grouped_sql(keys: list[str], where: str = _SCOPE, signature: bool = False, source: str = "cdr") -> str:
    dims = ", ".join(f"{_DIM_SQL[k]} AS {k}" for k in keys)
    extra = ""
    if signature:
        extra = ", ".join(f"min({_DIM_SQL[s]}) AS {s}" for s in reports.SIGNATURE) + ","
    places = ", ".join(str(i + 1) for i in range(len(keys)))
    return f"SELECT {dims}, {extra} {_BLOCK} FROM {source} WHERE {where} GROUP BY {places}"


def _top(sql: str, sort: str, keys: list[str], limit: int | None = None) -> str:
    ties = ", ".join(f"{k} ASC NULLS LAST" for k in keys)
    tail = f" LIMIT {limit}" if limit else ""
    return f"SELECT * FROM ({sql}) ORDER BY {sort} NULLS LAST, {ties}{tail}"


def _with(sql: str) -> str:
    return f"WITH {CDR} {sql}"


PARAMS = report_params(FIRST_DAY, STAR_ENTITIES, end_date=LAST_DAY)
CUST = reports.CUSTOMER_CODE_KEYS
_CUST_SQL = _grouped_sql(CUST, signature=True)


# --- grouped reports -------------------------------------------------------------------

@query("usa_codes", _with(_top(_grouped_sql(reports.CODE_KEYS), "revenue DESC", reports.CODE_KEYS)))
def _(spark, sf):
    return reports.codes_report(star_records(spark, sf), PARAMS).rows


@query("usa_codes_totals", _with(
    f"SELECT count(*) AS code_count, {_TOTALS} FROM ({_grouped_sql(reports.CODE_KEYS)})"))
def _(spark, sf):
    return reports.codes_report(star_records(spark, sf), PARAMS).totals


@query("customer_codes", _with(_top(_CUST_SQL, "revenue DESC", CUST)))
def _(spark, sf):
    return reports.customer_codes_report(star_records(spark, sf), PARAMS).rows


@query("customer_codes_totals", _with(
    "SELECT count(*) AS pair_count, count(DISTINCT customer) AS customer_count, "
    f"count(DISTINCT code) AS code_count, {_TOTALS} FROM ({_grouped_sql(CUST)})"))
def _(spark, sf):
    return reports.customer_codes_report(star_records(spark, sf), PARAMS, with_signature=False).totals


@query("customer_codes_names", _with(
    f"SELECT DISTINCT {_DIM_SQL['customer']} AS customer FROM cdr WHERE {_SCOPE} ORDER BY 1"))
def _(spark, sf):
    report = reports.customer_codes_report(star_records(spark, sf), PARAMS, with_signature=False)
    return report.distinct("customer")


@query("customer_codes_name_list", _with(
    f"SELECT array_to_string(list_sort(list(DISTINCT {_DIM_SQL['customer']})), '|') AS customers "
    f"FROM cdr WHERE {_SCOPE}"))
def _(spark, sf):
    report = reports.customer_codes_report(star_records(spark, sf), PARAMS, with_signature=False)
    return reports.customer_array(report).select(F.array_join("customers", "|").alias("customers"))


@query("customer_codes_with_count", _with(
    f"SELECT *, count(*) OVER () AS filtered_row_count FROM ({_CUST_SQL}) WHERE margin > 0 "
    f"ORDER BY revenue DESC, {', '.join(CUST)}"))
def _(spark, sf):
    params = replace(PARAMS, quick_filter="profitable")
    return reports.customer_codes_report(star_records(spark, sf), params).stored().rows_with_count


_PRESET_SQL = {
    "worst-margin": ("margin ASC", "true"),
    "top-revenue": ("revenue DESC", "true"),
    "top-traffic": ("attempts DESC", "true"),
    "fas-suspect": ("attempts DESC", "asr_pct < 15 AND attempts >= 50"),
    "profitable": ("margin DESC", "margin > 0"),
}


def _preset(name: str):
    sort, having = _PRESET_SQL[name]
    sql = _with(_top(f"SELECT * FROM ({_CUST_SQL}) WHERE {having}", sort, CUST, 500))

    @query("customer_codes_" + name.replace("-", "_").replace("fas_suspect", "fas"), sql)
    def _(spark, sf):
        params = with_table_preset(replace(PARAMS, limit=500), name)
        return reports.customer_codes_report(star_records(spark, sf), params).rows


for _name in _PRESET_SQL:
    _preset(_name)


@query("stir_x5u", _with(_top(_grouped_sql(reports.CERTIFICATE_KEYS), "revenue DESC", reports.CERTIFICATE_KEYS)))
def _(spark, sf):
    return reports.certificates_report(star_records(spark, sf), PARAMS).rows


@query("stir_x5u_totals", _with(
    f"SELECT count(*) AS x5u_count, {_TOTALS} FROM ({_grouped_sql(reports.CERTIFICATE_KEYS)})"))
def _(spark, sf):
    return reports.certificates_report(star_records(spark, sf), PARAMS).totals


_NPA_SQL = "npa(npa, mapped) AS (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in STAR_AREA_CODES) + ")"


def _state_sql(side: str) -> tuple[str, str]:
    placed = (
        f"placed AS (SELECT cdr.* REPLACE (coalesce(mapped, nullif(nullif(trim({side}_state), ''), 'tfree'), '?') "
        f"AS term_state) FROM cdr LEFT JOIN npa "
        f"ON npa.npa = substr(regexp_replace({side}_billed_prefix, '^1', ''), 1, 3))"
    )
    return f"WITH {CDR}, {_NPA_SQL}, {placed} ", _grouped_sql(reports.CUSTOMER_STATE_KEYS, source="placed")


def _state_queries(side: str):
    head, grouped = _state_sql(side)

    @query(f"customer_state_{side}", head + _top(grouped, "minutes DESC", reports.CUSTOMER_STATE_KEYS))
    def _(spark, sf):
        params = replace(PARAMS, state_side=side, sort_by="minutes")
        return reports.customer_state_report(star_records(spark, sf), params, star_area_codes(spark)).rows

    @query(f"customer_state_{side}_totals", head + (
        f"SELECT count(DISTINCT customer) AS customer_count, count(DISTINCT state) AS state_count, {_TOTALS} "
        f"FROM ({grouped})"))
    def _(spark, sf):
        params = replace(PARAMS, state_side=side)
        return reports.customer_state_report(star_records(spark, sf), params, star_area_codes(spark)).totals


_state_queries("orig")
_state_queries("term")


@query("customers", _with(
    f"SELECT DISTINCT orig_trunk_group_name AS name FROM cdr WHERE {_SCOPE} "
    "AND orig_trunk_group_name IS NOT NULL AND orig_trunk_group_name <> '' ORDER BY name"))
def _(spark, sf):
    return reports.customers(star_records(spark, sf), PARAMS)


# --- filters ------------------------------------------------------------------------------

_HOUR = "extract(hour FROM call_end_time)"


@query("hour_window", _with(_top(
    _grouped_sql(CUST, f"{_SCOPE} AND {_HOUR} BETWEEN 9 AND 17"), "revenue DESC", CUST)))
def _(spark, sf):
    params = with_hour_preset(PARAMS, "business")
    return reports.customer_codes_report(star_records(spark, sf), params, with_signature=False).rows


@query("hour_window_wrap", _with(_top(
    _grouped_sql(CUST, f"{_SCOPE} AND ({_HOUR} >= 22 OR {_HOUR} <= 6)"), "revenue DESC", CUST)))
def _(spark, sf):
    params = with_hour_preset(PARAMS, "overnight")
    return reports.customer_codes_report(star_records(spark, sf), params, with_signature=False).rows


@query("reason_filter", _with(_top(
    _grouped_sql(reports.CODE_KEYS, f"{_SCOPE} AND sip_code IN (503) AND reason IN ('NO_VENDOR_RATE')"),
    "revenue DESC", reports.CODE_KEYS)))
def _(spark, sf):
    params = replace(PARAMS, sip_codes=(503,), reasons=("NO_VENDOR_RATE",))
    return reports.codes_report(star_records(spark, sf), params).rows


@query("scoped_filter", _with(_top(
    _grouped_sql(CUST, f"{_SCOPE} AND entity IN ('E1','E3') AND orig_trunk_group_name = 'BUILDING-0' "
                       "AND file_hour >= TIMESTAMP '2024-01-08' AND file_hour < TIMESTAMP '2024-01-15' "
                       "AND sip_code IN (200, 486)", signature=True),
    "customer ASC", CUST)))
def _(spark, sf):
    params = report_params(
        "2024-01-08", STAR_ENTITIES, end_date="2024-01-14", entities=["E1", "E3"],
        customer=" BUILDING-0 ", sip_codes=[200, 486, 200], sort_by="customer", sort_dir="asc",
    )
    return reports.customer_codes_report(star_records(spark, sf), params).rows


@query("search_filter", _with(
    f"SELECT * FROM ({_CUST_SQL}) WHERE contains(lower(code), 'rc1') OR contains(lower(term_code), 'rc1') "
    "OR contains(lower(state), 'rc1') OR contains(lower(ratecenter), 'rc1') OR contains(lower(customer), 'rc1')"))
def _(spark, sf):
    report = reports.customer_codes_report(star_records(spark, sf), PARAMS)
    return reports.search_rows(report.groups, " Rc1 ")


@query("row_flags", _with(
    f"SELECT x5u_url, attest, margin, asr_pct, "
    "CASE WHEN margin < 0 THEN 'loss' WHEN margin > 0 THEN 'gain' ELSE 'even' END AS margin_flag, "
    "CASE WHEN asr_pct < 15 THEN 'warn' WHEN asr_pct >= 40 THEN 'good' ELSE 'fair' END AS asr_flag "
    f"FROM ({_grouped_sql(reports.CERTIFICATE_KEYS)})"))
def _(spark, sf):
    groups = reports.certificates_report(star_records(spark, sf), PARAMS).groups
    flagged = metrics.with_row_flags(groups)
    return flagged.select("x5u_url", "attest", "margin", "asr_pct", "margin_flag", "asr_flag")


@query("margin_pct", _with(
    "SELECT x5u_url, attest, round((100.0::DOUBLE * margin / nullif(revenue, 0))::DECIMAL(18,9), 1)::DOUBLE "
    f"AS margin_pct FROM ({_grouped_sql(reports.CERTIFICATE_KEYS)})"))
def _(spark, sf):
    groups = reports.certificates_report(star_records(spark, sf), PARAMS).groups
    return metrics.with_margin_pct(groups).select("x5u_url", "attest", "margin_pct")


# --- rollups and panels -----------------------------------------------------------------------

def _fill(col: str, word: str) -> str:
    return f"coalesce(nullif({col}, ''), '{word}') AS {col}"


_MEDIA_SQL = f"""
media AS (SELECT event_time::DATE AS day, date_trunc('hour', event_time) AS hour, entity,
{_fill('term_media_ip', '(none)')}, {_fill('term_ip', '(none)')}, {_fill('term_carrier_name', '(none)')},
{_fill('term_trunk_group_name', '(none)')}, {_fill('orig_trunk_group_name', '(none)')}, sip_code,
{_fill('reason', '(none)')}, {_fill('stir_attest', '?')}, {_fill('term_state', '?')},
{_fill('term_ratecenter', '?')},
count(*) AS attempts, count(*) FILTER (sip_code = 200) AS completions,
coalesce(sum(orig_billed_duration) FILTER (sip_code = 200), 0)::BIGINT AS billed_seconds,
sum(orig_cost::DECIMAL(18,8))::DOUBLE AS revenue, sum(term_cost::DECIMAL(18,8))::DOUBLE AS cost,
coalesce(sum(pdd) FILTER (pdd > 0), 0)::BIGINT AS pdd_sum, count(*) FILTER (pdd > 0) AS pdd_count,
coalesce(sum(mos_avg::DECIMAL(18,8)) FILTER (mos_avg > 0), 0)::DOUBLE AS mos_sum,
count(*) FILTER (mos_avg > 0) AS mos_count FROM cdr GROUP BY 1,2,3,4,5,6,7,8,9,10,11,12,13)
"""
_RELEASE = "coalesce(nullif(reason, ''), nullif(sip_reason, ''), 'Not provided')"
_REASON_SQL = f"""
reasons AS (SELECT event_time::DATE AS day, date_trunc('hour', event_time) AS hour, entity,
{_fill('orig_trunk_group_name', '(none)')}, coalesce(term_state, '') AS term_state,
coalesce(orig_billed_prefix, '') AS billed_prefix, sip_code, {_RELEASE} AS reason, count(*) AS attempts
FROM cdr GROUP BY 1,2,3,4,5,6,7,8)
"""


def _media(spark, sf):
    return rollups.media_rollup(star_records(spark, sf))


def _reasons(spark, sf):
    return rollups.reason_rollup(star_records(spark, sf))


def _stored_reasons(spark, sf):
    """The rollup as the table it is in use: readers scan it more than once."""
    return written(_reasons(spark, sf), "reasons")


def _panel(sql: str, table: str) -> str:
    return f"WITH {CDR}, {table} {sql}"


@query("hourly_media_rollup", _panel("SELECT * FROM media", _MEDIA_SQL))
def _(spark, sf):
    # A freshly built rollup has one row per key, so reading it needs no merge.
    c = F.col
    return _media(spark, sf).select(
        *rollups.MEDIA_KEYS, "attempts", "completions", "billed_seconds",
        metrics.from_units(c("revenue_units")).alias("revenue"),
        metrics.from_units(c("cost_units")).alias("cost"),
        "pdd_sum", "pdd_count", metrics.from_units(c("mos_units")).alias("mos_sum"), "mos_count",
    )


@query("sip_reason_rollup", _panel("SELECT * FROM reasons", _REASON_SQL))
def _(spark, sf):
    return _reasons(spark, sf)


@query("rollup_remerge", _panel("SELECT * FROM media", _MEDIA_SQL))
def _(spark, sf):
    """Partial rollups of two halves of the records, appended and merged on read."""
    records = star_records(spark, sf)
    odd = F.col("pdd") % 2 == 1
    halves = [rollups.media_rollup(records.where(odd)), rollups.media_rollup(records.where(~odd))]
    return rollups.merged_media(halves[0].unionByName(halves[1]))


_SPAN = PanelFilter(start=datetime(2024, 1, 5, 6), end=datetime(2024, 1, 20, 18))
_RANGE = "hour BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'"


@query("route_map", _panel(f"""
SELECT entity, orig_trunk_group_name, term_carrier_name, term_trunk_group_name, term_ip, term_media_ip,
max(hour) AS last_seen, sum(attempts)::BIGINT AS cdrs, sum(completions)::BIGINT AS answered,
(sum(attempts) - sum(completions))::BIGINT AS failed,
round(100.0 * sum(completions) / nullif(sum(attempts), 0), 2)::DOUBLE AS answer_rate
FROM media WHERE {_RANGE} AND term_media_ip <> '(none)' GROUP BY 1,2,3,4,5,6
ORDER BY cdrs DESC, 1,2,3,4,5,6 LIMIT 1000""", _MEDIA_SQL))
def _(spark, sf):
    return rollups.route_map(_media(spark, sf), _SPAN)


@query("top_media_ips", _panel("""
SELECT term_media_ip, orig_trunk_group_name, term_carrier_name, term_trunk_group_name,
max(hour) AS last_seen, sum(attempts)::BIGINT AS cdrs FROM media
WHERE term_media_ip <> '(none)' AND entity = 'E2' GROUP BY 1,2,3,4 ORDER BY cdrs DESC, 1,2,3,4 LIMIT 50""", _MEDIA_SQL))
def _(spark, sf):
    return rollups.busiest_media_ips(_media(spark, sf), PanelFilter(entity="E2"))


@query("failures_by_route", _panel("""
SELECT term_media_ip, orig_trunk_group_name, term_carrier_name, term_trunk_group_name, sip_code, reason,
sum(attempts)::BIGINT AS failed_cdrs FROM media WHERE term_media_ip <> '(none)' AND sip_code <> 200
GROUP BY 1,2,3,4,5,6 ORDER BY failed_cdrs DESC, 1,2,3,4,5,6 LIMIT 500""", _MEDIA_SQL))
def _(spark, sf):
    return rollups.failures_by_route(_media(spark, sf))


def _grid_sql(where: str, limit: int) -> str:
    return f"""
custs AS (SELECT DISTINCT orig_trunk_group_name AS customer FROM reasons
  WHERE orig_trunk_group_name <> '(none)' AND {where}),
sts AS (SELECT DISTINCT term_state AS state FROM reasons WHERE term_state <> '' AND {where}),
actual AS (SELECT orig_trunk_group_name AS customer, term_state AS state,
  coalesce(nullif(billed_prefix, ''), '—') AS code, sip_code::VARCHAR || ' - ' || reason AS sip_reason,
  sum(attempts)::BIGINT AS attempts FROM reasons WHERE term_state <> '' AND {where} GROUP BY 1,2,3,4),
tot AS (SELECT customer, state, sum(attempts) AS t FROM actual GROUP BY 1,2)
SELECT g.customer, g.state, coalesce(a.code, '—') AS code, coalesce(a.sip_reason, '(no traffic)') AS sip_reason,
coalesce(a.attempts, 0) AS attempts, coalesce(round(100.0 * a.attempts / tot.t, 2), 0)::DOUBLE AS pct_of_pair
FROM (SELECT * FROM custs CROSS JOIN sts) g LEFT JOIN actual a ON g.customer = a.customer AND g.state = a.state
LEFT JOIN tot ON g.customer = tot.customer AND g.state = tot.state
ORDER BY attempts DESC, 1,2,3,4 LIMIT {limit}"""


@query("sip_reason_grid", f"WITH {CDR}, {_REASON_SQL}, {_grid_sql('true', 5000)}")
def _(spark, sf):
    return rollups.reason_grid(_stored_reasons(spark, sf))


_GAP_HOUR = "entity = 'E3' AND hour BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-03 03:00:00'"


@query("sip_reason_grid_gaps", f"WITH {CDR}, {_REASON_SQL}, {_grid_sql(_GAP_HOUR, 100000)}")
def _(spark, sf):
    """A narrow window, where many trunk and state pairs have no traffic."""
    flt = PanelFilter(start=datetime(2024, 1, 3), end=datetime(2024, 1, 3, 3), entity="E3")
    return rollups.reason_grid(_stored_reasons(spark, sf), flt, limit=None)


@query("sip_reason_share", f"""WITH {CDR}, {_REASON_SQL}
SELECT orig_trunk_group_name AS customer, term_state AS state, coalesce(nullif(billed_prefix, ''), '—') AS code,
sip_code::VARCHAR || ' - ' || reason AS sip_reason, sum(attempts)::BIGINT AS attempts,
round(100.0 * sum(attempts) / sum(sum(attempts)) OVER (PARTITION BY orig_trunk_group_name, term_state), 2)::DOUBLE
AS pct_of_pair FROM reasons WHERE term_state <> '' AND orig_trunk_group_name <> '(none)' GROUP BY 1,2,3,4""")
def _(spark, sf):
    rollup = _stored_reasons(spark, sf)
    return rollups.with_pair_share(rollups.reason_grid_traffic(rollup), rollups.pair_totals(rollup))


def _filter_query(name: str, column: str, where: str):
    # Values come as text ordered by the column itself; the twin compares sets.
    sql = f"SELECT DISTINCT {column}::VARCHAR AS value FROM media WHERE {where}"

    @query(f"filter_values_{name}", _panel(sql, _MEDIA_SQL))
    def _(spark, sf):
        flt = replace(_SPAN, entity="E1", origin_trunk="BUILDING-0" if name != "origin_trunk" else None)
        return rollups.filter_values(_media(spark, sf), name, flt)


_CHOSEN = f"{_RANGE} AND entity = 'E1'"
_filter_query("entity", "entity", "true")
_filter_query("origin_trunk", "orig_trunk_group_name", f"{_CHOSEN} AND orig_trunk_group_name <> '(none)'")
for _name, _col in (("vendor", "term_carrier_name"), ("trunk", "term_trunk_group_name"), ("media_ip", "term_media_ip")):
    _filter_query(_name, _col, f"{_CHOSEN} AND orig_trunk_group_name = 'BUILDING-0' AND {_col} <> '(none)'")
_filter_query("sip_code", "sip_code", _RANGE)


@query("hour_row_counts", _with(
    "SELECT entity, file_hour, count(*) AS rows FROM cdr GROUP BY 1, 2"))
def _(spark, sf):
    return rollups.hour_counts(star_records(spark, sf))


# --- watchlist -----------------------------------------------------------------------------------

_WATCH_SQL = "watch(ip) AS (VALUES " + ", ".join(f"('{ip}')" for ip in WATCHED) + ")"
_HITS_SQL = f"""{_WATCH_SQL}, hits AS (SELECT hour, trim(term_media_ip) AS termination_media_ip, entity,
orig_trunk_group_name, term_carrier_name, term_trunk_group_name, term_ip, sum(attempts)::BIGINT AS matching_cdrs
FROM media WHERE trim(term_media_ip) IN (SELECT ip FROM watch) GROUP BY 1,2,3,4,5,6,7)"""


def _watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ip,) for ip in WATCHED], WATCHLIST_SCHEMA)


def _hits(spark, sf):
    return watchlist.watch_hits(_media(spark, sf), _watchlist(spark))


@query("watch_hits", _panel("SELECT * FROM hits", f"{_MEDIA_SQL}, {_HITS_SQL}"))
def _(spark, sf):
    return _hits(spark, sf)


@query("watch_status", _panel("""
SELECT CASE WHEN (SELECT count(*) FROM watch) = 0 THEN -1 ELSE count(DISTINCT termination_media_ip) END
AS watched_ip_status FROM hits""", f"{_MEDIA_SQL}, {_HITS_SQL}"))
def _(spark, sf):
    return watchlist.alert_status(_hits(spark, sf), _watchlist(spark))


@query("watch_matches", _panel("""
SELECT termination_media_ip, entity, orig_trunk_group_name, term_carrier_name, term_trunk_group_name, term_ip,
min(hour) AS first_seen, max(hour) AS last_seen, sum(matching_cdrs)::BIGINT AS matching_cdrs FROM hits
GROUP BY 1,2,3,4,5,6 ORDER BY last_seen DESC, 1,2,3,4,5,6 LIMIT 500""", f"{_MEDIA_SQL}, {_HITS_SQL}"))
def _(spark, sf):
    return watchlist.watched_matches(_hits(spark, sf))


_OUTCOME = "CASE WHEN sip_code = 200 THEN 'Answered' ELSE 'Failed' END"


@query("watched_cdrs", _panel(f"""
SELECT call_start_time AS call_started, call_end_time AS call_ended, entity,
coalesce(orig_trunk_group_name, '') AS customer_trunk, term_trunk_group_name AS termination_trunk, term_ip,
trim(term_media_ip) AS termination_media_ip, from_did, to_did, sip_code, {_OUTCOME} AS result,
{_RELEASE} AS release_reason, callid FROM cdr, (SELECT max(hour) AS latest FROM hits)
WHERE event_time >= latest - INTERVAL 24 HOUR AND event_time < latest + INTERVAL 1 HOUR
AND trim(term_media_ip) IN (SELECT ip FROM watch) ORDER BY event_time DESC, callid, call_start_time LIMIT 1000""",
                              f"{_MEDIA_SQL}, {_HITS_SQL}"))
def _(spark, sf):
    # The hits are a table in use, read here for their newest hour only.
    hits = written(_hits(spark, sf), "hits")
    return watchlist.watched_records(star_records(spark, sf), hits, _watchlist(spark))


# Half of the addresses written as version 6, in two spellings each; the list has a third one.
_LAST = "split_part(trim(term_media_ip), '.', 4)"
_V6_SPELLED = f"""CASE WHEN term_media_ip = '(none)' THEN term_media_ip WHEN CAST({_LAST} AS INT) % 3 = 0 THEN ' 2001:DB8::' || {_LAST}
WHEN CAST({_LAST} AS INT) % 3 = 1 THEN '2001:0db8:0000:0:0:0:0:' || lpad({_LAST}, 4, '0') ELSE term_media_ip END"""
_V6_LIST = ("2001:db8:0::12", "2001:DB8::0:10", "203.0.113.50", "::FFFF:192.0.2.1")


@query("watch_hits_v6", _panel(f"""
SELECT hour, CASE WHEN CAST({_LAST} AS INT) = 50 THEN '203.0.113.50' ELSE '2001:db8::' || {_LAST} END AS termination_media_ip, entity, orig_trunk_group_name,
term_carrier_name, term_trunk_group_name, term_ip, sum(attempts)::BIGINT AS matching_cdrs FROM media WHERE term_media_ip <> '(none)'
AND CAST({_LAST} AS INT) IN (10, 12, 50) GROUP BY 1,2,3,4,5,6,7""", _MEDIA_SQL))
def _(spark, sf):
    """Watch hits where traffic and list spell the same version-6 addresses in different ways."""
    traffic = _media(spark, sf).withColumn("term_media_ip", F.expr(_V6_SPELLED))
    return watchlist.watch_hits(traffic, spark.createDataFrame([(ip,) for ip in _V6_LIST], WATCHLIST_SCHEMA))


_LINE_SQL = "SELECT ' 203.0.113.' || (s_suppkey % 300) || ' ,bad-' || (s_suppkey % 7) || ';' || " \
            "'10.0.' || s_nationkey || '.1' AS line FROM supplier"
_PIECES_SQL = f"SELECT DISTINCT unnest(regexp_split_to_array(line, '[\\s,;]+')) AS candidate FROM ({_LINE_SQL})"
_IS_IP = "regexp_full_match(candidate, '((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.|$)){4}')"


def _address_lines(spark, sf):
    suppliers = read_table(spark, sf, "supplier")
    return suppliers.selectExpr(
        "concat(' 203.0.113.', s_suppkey % 300, ' ,bad-', s_suppkey % 7, ';', '10.0.', s_nationkey, '.1') AS line"
    )


@query("watchlist_parse", f"SELECT candidate AS termination_media_ip FROM ({_PIECES_SQL}) WHERE {_IS_IP}")
def _(spark, sf):
    from callmeter.functions.network import parse_addresses

    return parse_addresses(_address_lines(spark, sf), "line")[0]


@query("watchlist_rejects", f"SELECT candidate FROM ({_PIECES_SQL}) WHERE candidate <> '' AND NOT {_IS_IP}")
def _(spark, sf):
    from callmeter.functions.network import parse_addresses

    return parse_addresses(_address_lines(spark, sf), "line")[1]


# --- detail ------------------------------------------------------------------------------------------

@query("cdr_detail", _with(f"""
SELECT call_start_time AS start_time, from_did AS ani, to_did AS dnis,
coalesce(orig_trunk_group_name, '') AS customer_trunk, sip_code, {_RELEASE} AS release_reason,
coalesce(nullif(orig_billed_prefix, ''), '?') AS billed_prefix, coalesce(term_state, '') AS state,
coalesce(term_ratecenter, '') AS rate_center, entity, callid FROM cdr
ORDER BY event_time DESC, callid, call_start_time LIMIT 10000"""))
def _(spark, sf):
    return detail.call_detail(star_records(spark, sf))


@query("cdr_detail_filtered", _with(f"""
SELECT call_start_time AS start_time, from_did AS ani, to_did AS dnis,
coalesce(orig_trunk_group_name, '') AS customer_trunk, sip_code, {_RELEASE} AS release_reason,
coalesce(nullif(orig_billed_prefix, ''), '?') AS billed_prefix, coalesce(term_state, '') AS state,
coalesce(term_ratecenter, '') AS rate_center, entity, callid FROM cdr
WHERE sip_code = 503 AND entity = 'E0' AND {_RANGE.replace('hour', 'event_time', 1)}
ORDER BY event_time DESC, callid, call_start_time LIMIT 10000"""))
def _(spark, sf):
    return detail.call_detail(star_records(spark, sf), replace(_SPAN, entity="E0", sip_code=503))


@query("routed_cdrs", _with(f"""
SELECT call_start_time AS call_started, call_end_time AS call_ended, entity,
coalesce(orig_trunk_group_name, '') AS customer_trunk, orig_carrier_name AS customer_carrier,
term_carrier_name AS vendor, term_trunk_group_name AS termination_trunk, term_ip, term_media_ip,
from_did, to_did, sip_code, {_OUTCOME} AS result, {_RELEASE} AS release_reason, duration_real AS duration_sec,
orig_billed_duration AS billable_sec, stir_attest AS attestation, round(mos_avg, 2)::DOUBLE AS mos, callid
FROM cdr WHERE term_media_ip <> '' ORDER BY event_time DESC, callid, call_start_time LIMIT 1000"""))
def _(spark, sf):
    return detail.routed_calls(star_records(spark, sf))


# --- prepared results ------------------------------------------------------------------------------------

HOT_DAY = date(2024, 1, 20)
_WINDOW_SQL = "windows(win, first_day, last_day) AS (VALUES " + ", ".join(
    f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in snapshots.hot_windows(HOT_DAY)) + ")"


def _hot_sql(keys: list[str], signature: bool) -> str:
    dims = ", ".join(f"{_DIM_SQL[k]} AS {k}" for k in keys)
    inner = f"SELECT win, entity AS ent, {dims}, {_DIM_SQL['x5u_url']} AS x5, {_DIM_SQL['attest']} AS att, " \
            "sip_code, orig_billed_duration, orig_cost, term_cost FROM cdr JOIN windows " \
            f"ON file_hour::DATE BETWEEN first_day AND last_day WHERE {_SCOPE}"
    names = ", ".join(keys)
    sig = "min(x5) AS x5u_url, min(att) AS attest," if signature else ""
    return (
        f"SELECT win AS \"window\", coalesce(ent, '(all)') AS entity, {names}, {sig} {_BLOCK} FROM ({inner}) "
        f"GROUP BY GROUPING SETS ((win, ent, {names}), (win, {names}))"
    )


@query("hot_window_grouping_sets", f"WITH {CDR}, {_WINDOW_SQL} {_hot_sql(reports.CODE_KEYS, False)}")
def _(spark, sf):
    return snapshots.hot_window_rows(star_records(spark, sf), HOT_DAY, with_customer=False, limit=None)


@query("hot_window_top", f"""WITH {CDR}, {_WINDOW_SQL} SELECT * FROM ({_hot_sql(CUST, True)}) h
QUALIFY row_number() OVER (PARTITION BY "window", entity
ORDER BY revenue DESC NULLS LAST, {', '.join(CUST)}) <= 100""")
def _(spark, sf):
    return snapshots.hot_window_rows(star_records(spark, sf), HOT_DAY, limit=100)


@query("hot_window_totals", f"""WITH {CDR}, {_WINDOW_SQL} SELECT "window", entity, count(*) AS group_count, {_TOTALS}
FROM ({_hot_sql(CUST, False)}) GROUP BY 1, 2""")
def _(spark, sf):
    return snapshots.hot_window_totals(star_records(spark, sf), HOT_DAY)


# One prepared result per entity and day of the records, refreshed some hours later.
_INDEX_SQL = """
days AS (SELECT entity, event_time::DATE AS day, count(*) AS n FROM cdr GROUP BY 1, 2),
idx AS (SELECT entity || '/' || day AS snapshot_key, 'customer-codes' AS report, day AS start_date, day AS end_date,
day + INTERVAL 1 DAY + to_hours((n % 5)::INTEGER) AS refreshed_at,
CASE WHEN DATE '2024-01-20' - day = 0 THEN 'today' WHEN DATE '2024-01-20' - day = 1 THEN 'yesterday'
WHEN DATE '2024-01-20' - day <= 3 THEN 'recent' ELSE 'historical' END AS tier FROM days)
"""


def _index(spark, sf):
    days = star_records(spark, sf).groupBy("entity", F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    day = F.col("day")
    refreshed = F.timestamp_seconds(
        F.unix_timestamp(F.date_add(day, 1).cast("timestamp")) + (F.col("n") % 5) * 3600
    )
    return days.select(
        F.concat_ws("/", "entity", day.cast("string")).alias("snapshot_key"),
        F.lit("customer-codes").alias("report"),
        day.alias("start_date"), day.alias("end_date"), refreshed.alias("refreshed_at"),
        snapshots.tier_of(day, day, F.lit(HOT_DAY)).alias("tier"),
    )


@query("snapshot_tiers", f"""WITH {CDR}, {_INDEX_SQL} SELECT tier, count(*) AS entries,
(SELECT count(*) FROM idx) AS total_entries, (SELECT min(end_date) FROM idx) AS oldest_end_date,
(SELECT max(end_date) FROM idx) AS newest_end_date FROM idx GROUP BY tier""")
def _(spark, sf):
    return snapshots.snapshot_stats(_index(spark, sf))


@query("snapshot_freshness", f"""WITH {CDR}, {_INDEX_SQL}, f AS (SELECT *,
CASE tier WHEN 'today' THEN 300 WHEN 'yesterday' THEN 900 WHEN 'recent' THEN 3600 ELSE 86400 END AS ttl,
(epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(refreshed_at))::BIGINT AS age_seconds FROM idx)
SELECT *, age_seconds > ttl AS stale FROM f""")
def _(spark, sf):
    return snapshots.with_freshness(_index(spark, sf), datetime(2024, 1, 20, 12))


@query("latest_snapshot", f"""WITH {CDR}, {_INDEX_SQL} SELECT * FROM idx
WHERE end_date BETWEEN DATE '2024-01-13' AND DATE '2024-01-19'
AND refreshed_at >= end_date + INTERVAL 26 HOUR ORDER BY end_date DESC, refreshed_at DESC, snapshot_key LIMIT 1""")
def _(spark, sf):
    return snapshots.latest_complete_day(_index(spark, sf), "customer-codes", HOT_DAY)


@query("snapshot_retention", f"""WITH {CDR}, {_INDEX_SQL} SELECT * FROM idx WHERE end_date >= DATE '2024-01-16'""")
def _(spark, sf):
    return snapshots.retained(_index(spark, sf), HOT_DAY)
