import pytest

from spanforge.llm import queries
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name])
