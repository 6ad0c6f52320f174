import pytest
from compare import connect, same

import __spark_entry__ as entry
from marlstone.plans.oracles import ORACLES
from marlstone.plans.queries import QUERIES

#: Hourly panels have no time that all symbols share at the smallest scale, so those run a size up.
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
