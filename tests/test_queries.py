"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# How many operators each family of the inventory has.
FAMILIES = {"s": 14, "p": 20, "n": 5, "t": 17, "j": 8, "a": 18, "w": 8, "o": 5, "m": 20, "r": 5, "x": 8}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_operator_has_a_query():
    # Queries of optional parts have names of another form.
    found = {m[0] for name in entry.queries() if (m := re.match(r"[a-z]\d+", name))}
    assert found == {f"{family}{i}" for family, n in FAMILIES.items() for i in range(1, n + 1)}
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    rows = entry.queries()[name](spark, SMALL).toPandas()
    assert difference(rows, con.execute(ORACLES[name]).df()) is None
