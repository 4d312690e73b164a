"""Every registered query against its SQL on the smallest tables; the others must return rows."""

import pytest
from check import compare, connect

from tiltmeter.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    message, rows = compare(spark, duck, name, queries()[name], ORACLE.get(name), SF)
    assert message is None, message
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
