"""Every registered query against its SQL."""

import pytest
from compare import database, rows_of_spark, rows_of_sql, types_of_spark, types_of_sql
from conftest import SMALL

import __spark_entry__ as entry
from reckon.catalogue import QUERIES as OWN

QUERIES = {name: query for name, query in entry.queries().items() if name in OWN}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_every_query_has_sql():
    assert QUERIES.keys() == OWN.keys() and QUERIES.keys() <= SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    result = QUERIES[name](spark, SMALL)
    assert types_of_spark(result) == types_of_sql(con, SQL[name])
    columns, rows = rows_of_spark(result)
    expected_columns, expected = rows_of_sql(con, SQL[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
