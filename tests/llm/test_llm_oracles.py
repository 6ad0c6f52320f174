import pytest
from compare import connect, same

from marlstone.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    same(LLM_QUERIES[name](spark, sf), con, LLM_ORACLES[name])
