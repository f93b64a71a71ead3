"""Every registered query with SQL agrees with DuckDB, also on the split plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from strandwise import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.all_sql()
SPLIT = [
    "gap_hours", "sessionize", "session_durations", "session_exclusion", "minute_states", "price_quantiles",
    "salary_profile", "price_profile_by_each", "customer_status_list", "job_summary", "rows_with_group_total",
    "rolling_mean", "first_change_point", "cooccurrence", "pair_mean", "term_correlation", "lumped_brands",
    "region_depth", "near_sequences", "covariate_balance", "unmatched_customers", "two_hop_lookup",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def compare(spark, db, name):
    df = entry.queries()[name](spark, SF)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(SQL[name])
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert mine[1] == theirs[1]
    assert mine[0] == theirs[0]


def test_registry():
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    compare(spark, db, name)


@pytest.mark.parametrize("name", SPLIT)
def test_split_plans(spark, db, hot, name):
    compare(spark, db, name)


@pytest.mark.parametrize("name", sorted(set(catalog.all_queries()) - set(SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
