"""The order of results, which the comparison with SQL does not see."""

from __future__ import annotations

import pytest

from saleroom import queries as catalogue

# (column, newest first?) in the order of the sort
ORDERS = {
    "bid_history": [("auction_id", False), ("bid_amount", True), ("created_at", False), ("id", False)],
    "sales_report": [("created_at", True), ("id", False)],
    "listing_cards": [("created_at", True), ("id", True)],
    "inbox_summary": [("last_message_at", True), ("conversation_id", False), ("user_id", False)],
    "recent_errors": [("created_at", True), ("id", True)],
}


def before(a, b, order):
    for column, newest in order:
        x, y = a[column], b[column]
        if x != y:
            return (x > y) if newest else (x < y)
    return True


@pytest.mark.parametrize("name", list(ORDERS))
def test_rows_come_in_order(market, name):
    rows = catalogue.CATALOGUE[name][0](market).collect()
    assert len(rows) > 1
    assert all(before(a, b, ORDERS[name]) for a, b in zip(rows, rows[1:]))
