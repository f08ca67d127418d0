"""Every query of the catalogue runs on the smallest tables and gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from kelpforge import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "NULL" if value != value else repr(round(value, 6))
    return "NULL" if value is None else str(value)


def rows(names, values):
    """Column names in order, and the values as the engines give them, so that a long is never taken for a double."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(row[k]) for k in order) for row in values)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, sql, name):
    frame = plans.QUERIES[name](spark, SF)
    got = rows(frame.columns, frame.collect())
    if name in plans.ORACLE_SQL:
        found = sql.execute(plans.ORACLE_SQL[name])
        assert got == rows([x[0] for x in found.description], found.fetchall())
    else:
        assert got[1]
