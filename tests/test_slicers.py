"""Slicers follow the relations: a predicate on one table narrows the tables on its many side."""

from __future__ import annotations

import pytest
from base_helpers import make_workspace, rows
from pyspark.sql import functions as F

from clickfold.plans.catalog import QUERIES


@pytest.fixture
def ws(spark):
    event = lambda i, user, kind, uri, seq: {
        "id": i, "user_id": user, "session_id": f"s{user}", "sequence_number": seq, "event_type": kind, "uri": uri,
        "traffic_source": "Web", "browser": "IE", "created_at": "2024-01-02 00:00:00 UTC"}
    return make_workspace(
        spark,
        users=[{"id": 1, "email": "a", "traffic_source": "X"}, {"id": 2, "email": "b", "traffic_source": "Y"}],
        orders=[{"order_id": 10 * u + k, "user_id": u, "status": "Complete", "created_at": f"2024-0{k}-01 00:00:00 UTC"}
                for u in (1, 2) for k in (1, 2)],
        order_items=[{"order_id": o, "product_id": p, "sale_price": None} for o in (11, 12, 21, 22) for p in (7, 8)],
        products=[{"id": 7, "category": "tea"}, {"id": 8, "category": "cups"}],
        inventory_events=[{"product_id": p, "created_at": "2024-01-01 00:00:00 UTC"} for p in (7, 8)],
        events=[event(1, "1", "product", "/product/7", 1), event(2, "1", "product", "/product/8", 2), event(3, "1", "cart", "/cart", 3),
                event(4, "2", "product", "/product/7", 1), event(5, "2", "cart", "/cart", 2), event(6, None, "cart", "/cart", 1)])


def test_users_narrow_orders_items_and_events(ws):
    cut = ws.sliced(users_temp=F.col("traffic_source") == "X")
    assert rows(cut.orders_temp, "order_id") == [(11,), (12,)]
    assert rows(cut.order_items_temp, "order_id", "product_id") == [(11, 7), (11, 8), (12, 7), (12, 8)]
    assert rows(cut.events_temp, "id") == [(1,), (2,), (3,)]
    assert rows(cut.stock_check, "product_id") == [(8,)] and rows(cut.products, "id") == [(7,), (8,)]


def test_months_of_orders_narrow_their_items_only(ws):
    cut = ws.sliced(orders_temp=F.month("created_date_clean") == 2)
    assert rows(cut.order_items_temp, "order_id") == [(12,), (12,), (22,), (22,)]
    assert cut.users_temp.count() == 2 and cut.events_temp.count() == 6


def test_products_narrow_carts_after_the_fill(ws):
    cut = ws.sliced(products=F.col("category") == "tea")
    assert rows(cut.stock_check, "session_id", "product_id") == [("s2", 7)]  # the cart of s1 still belongs to product 8
    assert rows(cut.order_items_temp, "product_id") == [(7,)] * 4 and rows(cut.stock_timeline, "product_id") == [(7,)]
    assert cut.events_temp.count() == 6


def test_several_slicers_together(ws):
    cut = ws.sliced(products=F.col("category") == "tea", users_temp=F.col("traffic_source") == "Y")
    assert rows(cut.order_items_temp, "order_id", "product_id") == [(21, 7), (22, 7)]
    assert rows(cut.stock_check, "session_id") == [("s2",)]
    assert QUERIES["abandonment_by_stock"](cut).collect()[0]["total_carts"] == 1
    with pytest.raises(KeyError):
        ws.sliced(stock_check=F.lit(True))
