"""Every query key of SURVEY §2 as a function ``Workspace -> DataFrame``, and the published views.

Keys P* are stages, A* derived tables and analysis queries, V* the twelve ``vw_*`` views, D* the
dashboard measures. ``register_views`` publishes the twelve views (and the staged tables) as temp
views, the Spark counterpart of ``CREATE OR ALTER VIEW``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.operators import staging
from clickfold.plans import abandonment as ab
from clickfold.plans import funnel as fn
from clickfold.plans import retention as rt
from clickfold.plans import scorecards as sc
from clickfold.plans import traffic as tr
from clickfold.plans.workspace import DERIVED, STAGED, Workspace

# Category threshold used to exercise revenue at risk on small data (FIXTURES.md §3): with the
# reference's 200 no category qualifies below sf1.
SMALL_DATA_MIN_ROWS = 15

Query = Callable[[Workspace], DataFrame]


def _sliced_abandonment(ws: Workspace, **slicers) -> DataFrame:
    return ab.abandonment_by_stock(ws.sliced(**slicers).cart_facts)


def _of_source(ws: Workspace, source: str) -> Workspace:
    return ws.sliced(users_temp=F.col("traffic_source") == source)


def _revenue(ws: Workspace) -> DataFrame:
    return tr.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp)


def _revenue_trend(ws: Workspace) -> DataFrame:
    return tr.revenue_trend_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp)


VIEWS: dict[str, Query] = {
    "vw_traffic_overview": lambda ws: tr.traffic_overview(ws.events_temp, ordered=False),
    "vw_revenue_by_traffic": lambda ws: tr.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp,
                                                             require_source=True),
    "vw_revenue_trend_by_traffic": lambda ws: tr.revenue_trend_by_source(ws.orders_temp, ws.order_items_temp,
                                                                         ws.users_temp, require_source=True),
    "vw_repeat_rate": lambda ws: rt.repeat_rate(ws.orders_temp, ws.users_temp, ordered=False),
    "vw_funnel_overview": lambda ws: fn.funnel_overall(ws.events_temp, with_total=True),
    "vw_funnel_by_traffic": lambda ws: fn.funnel(ws.events_temp, "traffic_source", ordered=False),
    "vw_funnel_by_browser": lambda ws: fn.funnel(ws.events_temp, "browser", ordered=False),
    "vw_product_to_cart_by_category": lambda ws: fn.product_to_cart_by_category(
        ws.events_temp, ws.cart_product_map, ws.products, ordered=False),
    "vw_abandonment_by_category": lambda ws: ab.abandonment_by_stock_category(ws.cart_facts, ws.products,
                                                                             ordered=False),
    "vw_abandonment_by_traffic": lambda ws: ab.abandonment_by_source(ws.cart_facts_sourced, ordered=False),
    "vw_abandonment_by_price_tier": lambda ws: ab.vw_abandonment_by_price_tier(ws.cart_facts, ws.products),
    "vw_revenue_at_risk": lambda ws: ab.revenue_at_risk(ws.cart_facts, ws.products, ordered=False),
}

QUERIES: dict[str, Query] = {
    # P: staging
    "stage_events": lambda ws: ws.events_temp,
    "stage_inventory_events": lambda ws: ws.inventory_events_temp,
    "stage_orders": lambda ws: ws.orders_temp,
    "stage_order_items": lambda ws: ws.order_items_temp,
    "dedupe_users": lambda ws: ws.users_temp,
    "orders_not_returned": lambda ws: staging.orders_not_returned(ws.orders_temp),
    # A: derived tables
    "abandoned_sessions": lambda ws: ab.abandoned_sessions(ws.events_temp),
    "abandoned_sessions_count": lambda ws: ab.abandoned_sessions_count(ws.events_temp),
    "cart_product_map": lambda ws: ws.cart_product_map,
    "stock_timeline": lambda ws: ws.stock_timeline,
    "stock_check": lambda ws: ws.stock_check,
    # A: metrics
    "users_by_source": lambda ws: tr.users_by_source(ws.users_temp),
    "traffic_overview": lambda ws: tr.traffic_overview(ws.events_temp),
    "revenue_by_source": _revenue,
    "revenue_trend_by_source": _revenue_trend,
    "sessions_trend_by_source": lambda ws: tr.sessions_trend_by_source(ws.events_temp),
    "order_gap_buckets": lambda ws: rt.order_gap_buckets(ws.orders_temp),
    "event_gap_buckets": lambda ws: rt.event_gap_buckets(ws.events_temp),
    "repeat_rate": lambda ws: rt.repeat_rate(ws.orders_temp, ws.users_temp),
    "funnel_by_source": lambda ws: fn.funnel(ws.events_temp, "traffic_source"),
    "funnel_by_browser": lambda ws: fn.funnel(ws.events_temp, "browser", order_by="product_view_sessions"),
    "funnel_overall": lambda ws: fn.funnel_overall(ws.events_temp),
    "abandonment_by_stock": lambda ws: ab.abandonment_by_stock(ws.cart_facts),
    "abandonment_by_stock_category": lambda ws: ab.abandonment_by_stock_category(ws.cart_facts, ws.products),
    "revenue_at_risk": lambda ws: ab.revenue_at_risk(ws.cart_facts, ws.products),
    "revenue_at_risk_min15": lambda ws: ab.revenue_at_risk(ws.cart_facts, ws.products, min_rows=SMALL_DATA_MIN_ROWS),
    "abandonment_by_source": lambda ws: ab.abandonment_by_source(ws.cart_facts_sourced),
    "abandonment_by_price_tier": lambda ws: ab.abandonment_by_price_tier(ws.cart_facts, ws.products),
    "product_to_cart_by_category": lambda ws: fn.product_to_cart_by_category(
        ws.events_temp, ws.cart_product_map, ws.products),
    # V: published views
    **VIEWS,
    "vw_revenue_at_risk_min15": lambda ws: ab.revenue_at_risk(ws.cart_facts, ws.products,
                                                              min_rows=SMALL_DATA_MIN_ROWS, ordered=False),
    # D: dashboard measures
    "overview_kpis": sc.overview_kpis,
    "overall_aov": sc.overall_aov,
    "overall_repeat_rate": sc.overall_repeat_rate,
    "highest_risk_cards": sc.highest_risk_cards,
    "traffic_mix": sc.traffic_mix,
    "channel_scorecard": sc.channel_scorecard,
    "revenue_at_risk_total": sc.revenue_at_risk_total,
    "revenue_at_risk_total_min15": lambda ws: sc.revenue_at_risk_total(ws, min_rows=SMALL_DATA_MIN_ROWS),
    # Slicers -- browser of the events, month of the orders, category of the products, source of the users
    "abandonment_by_stock_chrome": lambda ws: _sliced_abandonment(ws, events_temp=F.col("browser") == "Chrome"),
    "revenue_by_source_march_1998": lambda ws: _revenue(ws.sliced(
        orders_temp=F.date_trunc("MONTH", "created_date_clean") == F.lit("1998-03-01 00:00:00").cast("timestamp_ntz"))),
    "abandonment_by_stock_promo": lambda ws: _sliced_abandonment(ws, products=F.col("category") == "PROMO"),
    "revenue_trend_of_source": lambda ws: _revenue_trend(_of_source(ws, "BUILDING")),
    "funnel_of_source": lambda ws: fn.funnel_overall(_of_source(ws, "BUILDING").events_temp, with_total=True),
}


def register_views(ws: Workspace, with_stages: bool = True) -> list[str]:
    """Publish the twelve ``vw_*`` views (and optionally the staged/derived tables) as temp views."""
    names = []
    if with_stages:
        for name in STAGED + DERIVED:
            getattr(ws, name).createOrReplaceTempView(name)
            names.append(name)
    for name, query in VIEWS.items():
        query(ws).createOrReplaceTempView(name)
        names.append(name)
    return names


def list_views(spark) -> list[str]:
    """The published views of this session (the reference lists ``sys.views`` named ``vw_%``)."""
    return sorted(t.name for t in spark.catalog.listTables(pattern="vw_*"))
