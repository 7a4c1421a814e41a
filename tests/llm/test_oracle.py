"""Queries with SQL against DuckDB on the small tables, and the registry."""

import pytest
from oracle import compare

from strata.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name]) > 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
