"""Every registered query against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload import fixtures
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "supplier", "nation")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_text():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "base_ym" and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    places = [want.columns.index(c) for c in cols]
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(repr(r[i]) for i in places) for r in want.fetchall())


def test_stored_inputs_give_the_same_rows(spark):
    """What the bench times on stored raw, wide and hourly rows is the same work."""
    names = ("a3_daily_trend", "p13_row_total", "a6_profile_base", "p14_int_flow")
    plain = {n: sorted(map(repr, QUERIES[n](spark, SF).collect())) for n in names}
    try:
        fixtures.store_inputs(spark, SF, 3)
        assert all(len(QUERIES[n](spark, SF).inputFiles()) >= 3 for n in names)
        assert {n: sorted(map(repr, QUERIES[n](spark, SF).collect())) for n in names} == plain
    finally:
        fixtures.forget_inputs()
