"""Registered queries that SQL can express against DuckDB, and the entry module's register."""

import os

import pytest
from wakeline.llm import queries

from tests.compare import check

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert check(spark, SF_DIR, queries.queries()[name], queries.oracle_sql()[name])


def test_register():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.queries()) | {"pipeline"} <= names and set(entry.oracle_sql()) <= names
