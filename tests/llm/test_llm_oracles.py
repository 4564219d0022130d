import compare
import pytest

from timeloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return compare.duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    assert compare.same(QUERIES[name](spark, small), con, ORACLES[name]) is None
