"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from verify import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(ours, duck.execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0
