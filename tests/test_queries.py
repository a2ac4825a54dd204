"""Queries against their SQL twins on the smallest scale.  ALL_QUERIES=1 runs the whole catalogue."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

DIR = "/root/testdata/sf0.001"
CORE = ["j03_asof_join", "j04_validity_interval_join", "j05_overlapping_interval_join", "e02_snapshot_month_frames", "e02_snapshot_fanout", "e09_asof_grid", "c01_percentile_rank",
        "c03_winsorise_standardise", "c08_cumulative_share", "g08_multi_factor_ols", "mk17_short_term_reversal", "mk24_industry_momentum", "vo02_ewma_range", "fu02_accruals", "fu25_sales_growth",
        "an10_change_in_recommendation", "a02_return_cleaning", "d02_linear_moments", "r03_double_sort_dependent", "v05_diebold_mariano", "p08_padded_split_repair", "a14_holiday_filter"]
SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if n in SQL and (os.environ.get("ALL_QUERIES") or n in CORE)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_catalogue_is_consistent():
    qs = entry.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) > 250
    assert set(CORE) <= set(qs)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    a, ca = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    b, cb = rows([x[0] for x in cur.description], cur.fetchall())
    assert ca == cb
    assert a == b


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"region", "bucket", "mean", "sr", "max_dd"} <= set(df.columns)
    assert df.count() > 0
