import pytest
from oracle import difference

from tarnlake.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], SF) == ""
