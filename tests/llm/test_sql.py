"""Registered queries against their SQL twins."""

import pytest
from oracle import compare, connect

from gaugeworks.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = connect(SF)
    assert compare(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) is None
    con.close()


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{n}" for n in range(1, 14)]
