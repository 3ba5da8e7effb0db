"""The queries that SQL can express next to their SQL on the smallest data set."""

import pytest

from tenantlake.llm.oracles import llm_oracles
from tenantlake.llm.queries import llm_queries
from tenantlake.verification.compare import connect, differences


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_same_rows_as_sql(spark, small, name):
    sql = llm_oracles()[name]
    assert differences(spark, small, name, llm_queries()[name], sql, connect(small)) is None


def test_entry_has_all_of_them():
    import __spark_entry__ as entry
    assert set(llm_queries()) <= set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {
        n.split("_")[0] for n in llm_queries() if n.startswith("op")}
