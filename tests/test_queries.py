"""Every registered query of the library against its DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from glossa.plans import registry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    compare(spark, con, sf, registry.QUERIES[name], registry.SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "macro_f1" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.SQL) <= set(registry.QUERIES)
