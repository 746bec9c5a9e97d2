"""Report exports."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING, TOO_MANY = "hours not loaded", "more rows than the cap of"


class ExportRefused(ValueError):
    """The export would be incomplete, or larger than the caller allows."""


# Column lists of the capped exports.
CODE_EXPORT_COLUMNS = (
    "code", "term_code", "state", "ratecenter", "attempts", "completions",
    "asr_pct", "minutes", "revenue", "cost", "margin",
)
CERTIFICATE_EXPORT_COLUMNS = (
    "x5u_url", "attest", "attempts", "completions", "asr_pct", "minutes", "revenue", "cost", "margin",
)


def write_csv(rows: DataFrame, path: str, columns=None) -> None:
    """CSV part files with a header; ordered rows stay ordered across the parts."""
    chosen = rows.select(*columns) if columns else rows
    chosen.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields included."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def complete_only(rows: DataFrame, missing: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """``rows``, but running the plan fails if ``missing`` has a row, or ``rows`` more than ``cap``.

    The checks are scalar subqueries of the plan: no job before the one that needs the rows, and they fail for
    an empty result too, since a subquery runs before the filter that reads it.
    """
    count = F.count(F.lit(1))
    checks = []
    if missing is not None:
        checks.append(missing.limit(1).agg(F.assert_true(count == 0, MISSING).cast("boolean").alias("ok")))
    if cap is not None:
        checks.append(rows.limit(cap + 1).agg(F.assert_true(count <= cap, f"{TOO_MANY} {cap}").cast("boolean").alias("ok")))
    for check in checks:
        rows = rows.where(check.scalar().isNull())
    return rows


def write_capped_csv(
    rows: DataFrame, path: str, columns, missing: DataFrame | None = None, cap: int | None = None
) -> None:
    """Export only complete results, and with a ``cap`` only results of at most that many rows.

    ``missing`` is the coverage check of the request (None skips it, as for the
    certificate export). A refused export writes no rows.
    """
    try:
        write_csv(complete_only(rows, missing, cap), path, columns)
    except (PySparkException, Py4JJavaError) as error:
        reason = next((r for r in (MISSING, TOO_MANY) if r in str(error)), None)
        if reason is None:
            raise
        raise ExportRefused(reason if reason == MISSING else f"{reason} {cap}") from error
