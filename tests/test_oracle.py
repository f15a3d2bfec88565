"""Every SQL-checkable registered query equals its DuckDB oracle on sf0.001."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck_connect

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], ORACLES[key], SF)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["owner_queue", "priority", "pred_reason_xgb", "open_cases", "avg_confidence",
                          "total_variance_amount", "total_recoverable_amount"]
    assert df.count() > 0


def test_every_query_has_a_callable_and_most_have_oracles():
    q = E.queries()
    assert set(ORACLES) <= set(q)
    assert len(q) >= 130 and len(ORACLES) >= 120
