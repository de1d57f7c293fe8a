"""Every query with an SQL equivalent gives the same rows as DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from footfall.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, datetime.datetime):
        return str(value)
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, views, name):
    made = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(made.columns) > 1
        return
    want = views.sql(sql).df()
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made) == rows(want)


def test_most_queries_have_sql():
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without <= {"zone_overlap", "calibration_issues", "dna_compare", "visitor_groups", "identity_continuation"}


def test_entry(spark):
    import __spark_entry__

    made = __spark_entry__.entry(spark)
    assert made.count() == 3 and set(catalog.queries()) <= set(__spark_entry__.queries())
