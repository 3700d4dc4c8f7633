"""Every registered query with a SQL text gives the rows that DuckDB gives; the others give rows."""

import duckdb
import pytest
from oracle import compare, views

from lurewatch.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return views(duckdb.connect(), sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, spark, sf, con):
    assert compare(spark, con, sf, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
