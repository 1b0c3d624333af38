import pytest

import __spark_entry__ as entry
from riskloom.plans import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    oracle.check(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_key", "date", "risk_score", "risk_level", "rebalanced", "ma"]
    assert df.filter("risk_score < 0 OR risk_score > 100").count() == 0
