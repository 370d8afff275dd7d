"""Every registered query against its SQL, on small tables."""

from __future__ import annotations

import pytest

from corpusloom.plans import registry
from tests.conftest import TABLES
from tests.oracle import same_rows

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, name):
    same_rows(registry.QUERIES[name](spark, small), registry.ORACLES[name], small, TABLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
