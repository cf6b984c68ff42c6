"""Every query with a SQL twin gives the same rows in both engines on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, duck, name):
    status, _, _, _, differences = compare(spark, duck, SMALL, name)
    assert status == "match", differences


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["date", "source_id", "source_name", "source_type", "item_count", "avg_threat_score"]
    assert df.count() > 0
