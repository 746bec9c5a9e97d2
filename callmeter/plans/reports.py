"""The grouped reports: codes, trunk × code, trunk × state, signing certificates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.functions import dims, metrics, predicates
from callmeter.operators.topk import ordering, top_rows, with_row_count
from callmeter.params import STATE_SORT_FIELDS, ReportParams
from callmeter.runtime import written

CODE_KEYS = ["code", "term_code", "state", "ratecenter"]
CUSTOMER_CODE_KEYS = ["customer", *CODE_KEYS]
CERTIFICATE_KEYS = ["x5u_url", "attest"]
CUSTOMER_STATE_KEYS = ["customer", "state"]
SIGNATURE = ["x5u_url", "attest"]

CODE_SEARCH = ["code", "term_code", "state", "ratecenter", "customer"]
STATE_SEARCH = ["state", "customer"]


@dataclass(frozen=True)
class Report:
    """Additive parts per group, and the results derived from them.

    ``parts`` can be materialised once (:meth:`stored`) when both the rows and
    the totals are wanted, since two actions would otherwise scan twice.
    """

    parts: DataFrame
    keys: tuple[str, ...]
    carried: tuple[str, ...] = ()
    counts: tuple[tuple[str, str], ...] = ()
    group_count: str | None = None
    sort_by: str = "revenue"
    sort_dir: str = "desc"
    limit: int | None = None
    having: str | None = None

    def stored(self) -> "Report":
        """Same report on parts written to the shared folder."""
        return replace(self, parts=written(self.parts, "report-parts"))

    @property
    def groups(self) -> DataFrame:
        """Every group with its reported metrics, unordered."""
        lead = [F.col(n) for n in (*self.keys, *self.carried)]
        return self.parts.select(*lead, *metrics.finished_metrics())

    @property
    def matching(self) -> DataFrame:
        """Groups that pass the quick filter."""
        condition = predicates.quick_filter(self.having)
        return self.groups if condition is None else self.groups.where(condition)

    @property
    def rows(self) -> DataFrame:
        """Ordered rows under the limit."""
        order = ordering(self.sort_by, self.sort_dir, list(self.keys))
        return top_rows(self.matching, order, self.limit)

    @property
    def rows_with_count(self) -> DataFrame:
        """Ordered rows, each with the number of groups behind the limit."""
        return with_row_count(self.rows, self.matching, "filtered_row_count")

    @property
    def totals(self) -> DataFrame:
        """One row over *all* groups; the quick filter and limit do not touch it."""
        extra: list[Column] = []
        if self.group_count:
            extra.append(F.count(F.lit(1)).alias(self.group_count))
        extra += [F.count_distinct(key).alias(name) for name, key in self.counts]
        return self.parts.agg(*extra, *metrics.summed_metrics())

    def distinct(self, key: str) -> DataFrame:
        """Ordered distinct values of one key, one row each."""
        return self.parts.select(key).distinct().orderBy(key)


def _grouped(records: DataFrame, dimensions: list[Column], keys: list[str]) -> DataFrame:
    """Additive parts per group. All buffers are longs, so this hash-aggregates."""
    needed = ["sip_code", "orig_billed_duration", "orig_cost", "term_cost"]
    return records.select(*dimensions, *needed).groupBy(*keys).agg(*metrics.partial_metrics())


def codes_report(records: DataFrame, params: ReportParams) -> Report:
    """Per rated code pair, state and rate centre; always by revenue, never filtered."""
    scope = predicates.report_scope(records, params)
    dimensions = [dims.code(), dims.term_code(), dims.state(), dims.ratecenter()]
    return Report(
        parts=_grouped(scope, dimensions, CODE_KEYS),
        keys=tuple(CODE_KEYS),
        group_count="code_count",
        limit=params.limit,
    )


def customer_codes_report(
    records: DataFrame, params: ReportParams, with_signature: bool = True, trunk_name: str = "customer"
) -> Report:
    """Per origin trunk and rated code, optionally with a signature of the group.

    The signature columns are the smallest value in the group. A string minimum
    would make Spark sort every record, so records are first hash-aggregated with
    the signature among the keys and only those few rows take the minimum.
    """
    scope = predicates.report_scope(records, params)
    dimensions = [
        dims.customer().alias(trunk_name), dims.code(), dims.term_code(), dims.state(), dims.ratecenter(),
    ]
    keys = [trunk_name, *CODE_KEYS]
    if with_signature:
        fine = _grouped(scope, [*dimensions, dims.x5u_url(), dims.attest()], keys + SIGNATURE)
        parts = fine.groupBy(*keys).agg(
            *[F.min(s).alias(s) for s in SIGNATURE], *metrics.merge_metrics()
        )
    else:
        parts = _grouped(scope, dimensions, keys)
    sort_by = trunk_name if params.sort_by == "customer" else params.sort_by
    return Report(
        parts=parts,
        keys=tuple(keys),
        carried=tuple(SIGNATURE) if with_signature else (),
        counts=(("customer_count", trunk_name), ("code_count", "code")),
        group_count="pair_count",
        sort_by=sort_by,
        sort_dir=params.sort_dir,
        limit=params.limit,
        having=params.quick_filter,
    )


EXPORT_COLUMNS = (
    "origin_trunk", "code", "term_code", "state", "ratecenter", "x5u_url", "attest",
    "attempts", "completions", "asr_pct", "minutes", "revenue", "cost", "margin",
)


def customer_codes_export(records: DataFrame, params: ReportParams) -> DataFrame:
    """Trunk × code rows for export: same grain, no limit, globally ordered."""
    report = customer_codes_report(records, params, trunk_name="origin_trunk")
    return replace(report, limit=None).rows.select(*EXPORT_COLUMNS)


def certificates_report(records: DataFrame, params: ReportParams) -> Report:
    """Per signing certificate and attestation level, by revenue."""
    scope = predicates.report_scope(records, params)
    return Report(
        parts=_grouped(scope, [dims.x5u_url(), dims.attest()], CERTIFICATE_KEYS),
        keys=tuple(CERTIFICATE_KEYS),
        group_count="x5u_count",
        limit=params.limit,
    )


def customer_state_report(records: DataFrame, params: ReportParams, area_codes: DataFrame) -> Report:
    """Per origin trunk and state of the rated prefix on the chosen side.

    Records are first reduced per (trunk, prefix, raw state), so the area-code
    lookup runs on those few rows. Totals cover all groups, not just the rows
    under the limit.
    """
    side = params.state_side
    prefix, raw_state = f"{side}_billed_prefix", f"{side}_state"
    scope = predicates.report_scope(records, params)
    reduced = _grouped(
        scope,
        [dims.customer(), F.col(prefix), F.col(raw_state)],
        ["customer", prefix, raw_state],
    )
    named = dims.with_billed_state(reduced, area_codes, prefix, raw_state)
    return Report(
        parts=named.groupBy(*CUSTOMER_STATE_KEYS).agg(*metrics.merge_metrics()),
        keys=tuple(CUSTOMER_STATE_KEYS),
        counts=(("customer_count", "customer"), ("state_count", "state")),
        sort_by=params.sort_by if params.sort_by in STATE_SORT_FIELDS else "minutes",
        sort_dir=params.sort_dir,
        limit=params.limit,
    )


STATE_EXPORT_COLUMNS = (
    "state", "customer", "attempts", "completions", "asr_pct", "minutes", "revenue", "cost", "margin",
)


def customers(records: DataFrame, params: ReportParams) -> DataFrame:
    """Named origin trunks seen in the period; outcome, reason and trunk filters do not apply."""
    wide = replace(params, sip_codes=(), reasons=(), customer=None)
    name = F.col("orig_trunk_group_name")
    return (
        predicates.report_scope(records, wide)
        .where(name.isNotNull() & (name != ""))
        .select(name.alias("name")).distinct().orderBy("name")
    )


def customer_array(report: Report, key: str = "customer", bound: int = 100_000) -> DataFrame:
    """The ordered distinct trunk names as one array value.

    An array lives in a single row, so it is only built for up to ``bound``
    names; :meth:`Report.distinct` returns any number as rows.
    """
    names = report.parts.select(key).distinct()
    if names.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} values; use Report.distinct for them as rows")
    return names.agg(F.array_sort(F.collect_list(key)).alias("customers"))


def search_rows(rows: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive search over the text columns a report has."""
    wanted = CODE_SEARCH if "code" in rows.columns else STATE_SEARCH
    return rows.where(predicates.search(text, [c for c in wanted if c in rows.columns]))
