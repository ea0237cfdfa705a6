import pytest
from oracle import compare

from stratum.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert compare(spark, name, catalog.queries()[name], sql, "/root/testdata/sf0.01") > 0
    else:
        assert catalog.queries()[name](spark, "/root/testdata/sf0.01").count() > 0
