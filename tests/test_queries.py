"""Every registered query runs, and gives the rows of its SQL where there is one."""

from __future__ import annotations

import pytest

from lodestone.plans.catalog import reference_oracles, reference_queries
from tests.checking import connection, rows
from tests.conftest import SF

QUERIES, ORACLES = reference_queries(), reference_oracles()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert {r["scope"] for r in __spark_entry__.entry(spark).collect()} == {"all", "group"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
