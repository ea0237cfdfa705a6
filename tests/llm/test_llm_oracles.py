import pytest
from oracle import compare

from stratum.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01") > 0
