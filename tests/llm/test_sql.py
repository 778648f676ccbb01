"""Queries with SQL of their own, on the smallest tables."""

import oracle
import pytest

from riskloom.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, name, sf):
    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], f"/root/testdata/{sf}") > 0
