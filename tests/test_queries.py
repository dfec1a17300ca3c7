"""Every query with SQL beside it, on the smallest tables."""

import pytest
from compare import differences, duck

from ledgerlight import plans


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, data, con, name):
    df = plans.QUERIES[name](spark, data)
    assert name in plans.ORACLE_SQL
    assert differences(df, con, plans.ORACLE_SQL[name]) == ""
