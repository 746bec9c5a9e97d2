"""Every registered query agrees with its DuckDB twin on the smallest tables."""

import pytest
from oracle import connect, duck_result, spark_result

import __spark_entry__ as entry
from callmeter import registry

SF = "/root/testdata/sf0.001"
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_of_the_reports_has_a_twin():
    """The optional text queries without one are tested against brute force beside their operators."""
    assert set(registry.ORACLE) == set(registry.QUERIES)
    assert set(TWINS) <= set(entry.queries())


@pytest.mark.parametrize("name", list(TWINS))
def test_query_matches_twin(spark, duck, name):
    columns, rows = spark_result(entry.queries()[name](spark, SF))
    wanted_columns, wanted = duck_result(duck, TWINS[name])
    assert columns == wanted_columns
    assert rows == wanted


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["customer", "code", "term_code"] and rows.limit(1).count() == 1


def test_limited_rows_are_ordered(spark, duck):
    """The order itself, which the comparison above leaves out."""
    for name in ("customer_codes", "customer_codes_worst_margin", "route_map", "sip_reason_grid", "cdr_detail"):
        df = entry.queries()[name](spark, SF)
        ours = [tuple(map(str, r)) for r in df.select("*").collect()]
        cur = duck.execute(TWINS[name])
        place = [[d[0] for d in cur.description].index(c) for c in df.columns]
        theirs = [tuple(str(r[i]) for i in place) for r in cur.fetchall()]
        assert ours == theirs, name
