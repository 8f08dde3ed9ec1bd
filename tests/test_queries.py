"""Every registered query against its SQL twin on the smallest given tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from gaugeworks.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    assert compare(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
