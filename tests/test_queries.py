"""Every registered query runs on sf0.001 and equals its DuckDB oracle (row multiset, column names)."""

import pytest

import __spark_entry__ as E
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = con.execute(SQL[name]).df()
    gc, gr = rows(got)
    wc, wr = rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
