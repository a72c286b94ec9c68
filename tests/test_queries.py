"""Every engine query gives the rows of its SQL."""

import pytest
from compare import connect, differences, rows

from quadspark import queries as Q


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, small, con, name):
    assert differences(Q.queries()[name](spark, small), con, Q.oracle_sql()[name]) == ""


def test_each_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


def test_comparison_sees_differences():
    assert rows(["a"], [(1,)]) != rows(["a"], [(2,)])
    assert rows(["a"], [(1,), (1,)]) != rows(["a"], [(1,)])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
