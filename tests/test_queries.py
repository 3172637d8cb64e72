import os

import duckdb
import pytest

from sparkweave.plans import addresses, calendar, events

QUERIES = calendar.QUERIES | events.QUERIES | addresses.QUERIES
SQL = calendar.SQL | events.SQL | addresses.SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours = QUERIES[name](spark, SF)
    theirs = con.sql(SQL[name])
    assert ours.columns == theirs.columns
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, ours.collect()), key=key) == sorted(theirs.fetchall(), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
