"""Every registered query with an SQL twin, compared row by row at the smallest scale."""

import pytest
from compare import DATA, compare, duck

import __spark_entry__ as contract

SF = f"{DATA}/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, contract.queries()[name], SQL[name], SF) is None


def test_twins_belong_to_queries():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
