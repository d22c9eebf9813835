"""Every query agrees with its SQL on the small data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from saleroom import queries as catalogue
from tests.compare import differences, duck
from tests.conftest import SMALL

QUERIES = catalogue.spark_queries()
ORACLE = catalogue.oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, ORACLE[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_returns_rows(spark):
    result = entry_points.entry(spark)
    assert result.columns == [
        "auction_id", "winner_id", "final_bid", "closed_at", "closed_reason", "is_paid"
    ]
    assert result.count() > 0
