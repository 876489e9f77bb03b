"""Every registered query of the library's own operators against DuckDB, over the smallest tables."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry
from tiltyard.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v):.5f}" if hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(name, spark, duck, small):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    other = duck.sql(catalogue.ORACLE[name])
    assert sorted(other.columns) == columns
    place = [other.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in place) for r in other.fetchall())


def test_entry_and_names(spark, small):
    best = entry.entry(spark)
    assert best.columns == ["segment", "rank", "deck_key", "rate", "n"] and best.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, small):
    """Filters and columns reach the scans."""
    from tiltyard.plans.tables import plays_of

    plan = catalogue.QUERIES["lookup_scan"](spark, small)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(l_quantity,50" in plan
    plan = plays_of(spark, small)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "l_extendedprice" not in plan and "Python" not in plan
