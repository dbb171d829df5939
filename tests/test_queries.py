"""Every registered query of the library against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from oracle import expected, rows

from knotweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    want = expected(registry.ORACLE_SQL[name], SF)
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
