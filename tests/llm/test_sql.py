import pytest

from tessera.llm import queries
from tests import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_to_sql(spark, name):
    assert compare.difference(spark, compare.database(SMALL), SMALL, queries.QUERIES[name], queries.SQL[name]) is None
