import pytest

from quern.catalog_queries import oracle_sql, queries
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries()))
def test_oracle(spark, sf, name):
    check(queries()[name](spark, sf), oracle_sql()[name], sf)
