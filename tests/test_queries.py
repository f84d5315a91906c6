"""Every query with SQL gives the rows of that SQL; every other one runs."""

from __future__ import annotations

import pytest

from marlstone.plans import registry
from tests.compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLE_SQL:
        assert_same(df, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
