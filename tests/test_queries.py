"""Every registered media-library query against its SQL."""

import pytest
from oracle import SF, same

from mendspan.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        same(rows, duck.sql(registry.ORACLE_SQL[name]))
    else:
        assert rows.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
