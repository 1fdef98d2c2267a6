"""Every query with SQL gives the rows of its SQL; every other query gives rows."""

import pytest
from oracle import connect, same

from tidemill.plans import catalog

SQL, QUERIES = catalog.oracle_sql(), catalog.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    same(spark, con, QUERIES[name], SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_needs_no_session_to_list_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
