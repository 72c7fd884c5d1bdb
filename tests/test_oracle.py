"""Every SQL-checked query equals its DuckDB oracle (sf0.001, the local twin
of the driver's gate)."""

import pytest

from conftest import SF_SMALL

from __spark_entry__ import oracle_sql, queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def duck():
    from tools.oracle_check import duck as make
    return make(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    from tools.oracle_check import check
    r = check(spark, duck, name, queries()[name], oracle_sql()[name], SF_SMALL)
    assert r.get("ok") is True, r
