"""Every registered query next to its SQL on the smallest data set."""

import pytest

from tenantlake.plans.catalog import all_queries
from tenantlake.verification.compare import connect, differences
from tenantlake.verification.oracle import all_oracles

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, con, name):
    assert differences(spark, small, name, QUERIES[name], ORACLES[name], con) is None


def test_entry():
    import __spark_entry__ as entry
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
