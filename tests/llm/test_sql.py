"""The corpus queries that SQL can express, against their SQL on a whole small table."""

import pytest
from oracle import same

from mendspan.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    assert rows.count() == 200
    assert "doc_id" in rows.columns
