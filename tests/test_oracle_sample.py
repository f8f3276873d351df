"""A sample of queries() against their DuckDB oracle on the smallest driver tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SAMPLE = ["fct_sleep", "dim_user", "kpi_snapshot", "calorie_drivers", "sleep_overview", "weekday_hour_pivot",
          "kruskal_weekday", "describe", "hexbin", "dq_checks"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(str(_norm(r[c])) for c in cols) for r in sdf.collect())
    rel = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    orows = sorted(tuple(str(_norm(r[names.index(c)])) for c in cols) for r in rel.fetchall())
    assert srows == orows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "avg_steps" in df.columns


def test_every_query_has_builder():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
