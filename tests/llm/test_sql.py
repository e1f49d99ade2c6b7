"""The operators' queries that SQL can express, against DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from glossa.llm import queries  # noqa: E402
from oracle import compare, connect  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    compare(spark, connect(sf), sf, queries.QUERIES[name], queries.SQL[name])
