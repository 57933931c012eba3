"""Every registered query, and the SQL of those that have one."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert compare(spark, duck, name, contract.queries()[name], contract.oracle_sql()[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_without_sql(spark, name):
    rows = contract.queries()[name](spark, SF).collect()
    assert rows
    for row in rows:
        found = row.asDict()
        assert not any(isinstance(v, float) and v != v for v in found.values())
        if found.get("ci_low") is not None and found.get("ci_high") is not None:
            assert found["ci_low"] <= found["ci_high"]
        if found.get("risk") is not None:
            assert 0 <= found["risk"] <= 1
