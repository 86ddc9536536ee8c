import pytest
from oracle import difference

from tarnlake.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, queries.queries()[name], SQL[name], "/root/testdata/sf0.001") == ""
