"""Every registered query of the language against its SQL in DuckDB, over whole tables."""

import os

import pytest

from tests.compare import check
from wakeline.queries import QUERIES, SQL

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert name in SQL
    check(spark, SF_DIR, QUERIES[name], SQL[name])
