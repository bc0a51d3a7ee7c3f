"""Dashboard measures (D1-D7); D8 slicers are :meth:`Workspace.sliced`.

The reference names these measures (overall AOV, overall repeat rate, TOPN "highest risk" cards,
traffic mix, channel scorecard, revenue at risk, overview KPIs) but ships no formula, so the
formulas are ours, built from the published views. Every input here is an aggregate with at most
one row per source, category or tier, so the global aggregates below move only a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clickfold.functions.semantics import REVENUE_AT_RISK_MIN_ROWS, money_total, rate, view_price_tier
from clickfold.operators.sessions import rollup
from clickfold.plans import abandonment, retention, traffic
from clickfold.plans.workspace import Workspace


def overall_aov(ws: Workspace) -> DataFrame:
    """Total revenue / total orders over V2 (an order has one user, hence one source)."""
    v2 = traffic.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp, require_source=True, buyers=False)
    return v2.agg(rate(money_total("total_revenue"), F.sum("total_orders")).alias("overall_aov"))


def overall_repeat_rate(ws: Workspace) -> DataFrame:
    """D3: repeat buyers / buyers over V4."""
    v4 = retention.repeat_rate(ws.orders_temp, ws.users_temp, ordered=False)
    return v4.agg(rate(F.sum("repeat_buyers"), F.sum("total_buyers")).alias("overall_repeat_rate"))


def traffic_mix(ws: Workspace) -> DataFrame:
    """Each session source's share of sessions (V1).

    The total is a window over the whole of V1, which has one row per source: the single window
    partition holds a handful of rows whatever the data size.
    """
    v1 = traffic.sessions_by_source(ws.events_temp)
    all_sessions = F.sum("total_sessions").over(Window.partitionBy())
    return v1.select("traffic_source", "total_sessions", rate("total_sessions", all_sessions).alias("session_share"))


def channel_scorecard(ws: Workspace) -> DataFrame:
    """Acquisition channel scorecard, V2 left-joined to V4 on source."""
    v2 = traffic.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp, require_source=True)
    v4 = (retention.repeat_rate(ws.orders_temp, ws.users_temp, ordered=False)
          .select("traffic_source", "repeat_buyers", "repeat_rate"))
    return v2.join(v4, "traffic_source", "left").select(
        "traffic_source", "total_orders", "total_buyers", "total_revenue", "aov", "repeat_buyers", "repeat_rate")


def revenue_at_risk_total(ws: Workspace, min_rows: int = REVENUE_AT_RISK_MIN_ROWS) -> DataFrame:
    """Headline revenue at risk, the sum of V12 (NULL when no category qualifies)."""
    v12 = abandonment.revenue_at_risk(ws.cart_facts, ws.products, min_rows, ordered=False)
    return v12.agg(money_total("revenue_at_risk").alias("revenue_at_risk_total"),
                   F.sum("abandoned_oos_events").alias("abandoned_oos_events"))


def overview_kpis(ws: Workspace) -> DataFrame:
    """Sessions (V5), revenue (sum of V2), overall AOV (D2) and cart abandonment rate (A15), 1 row.

    One rollup of the events gives every session's purchase flag; the carts of a session join it, so the
    same rows count all sessions and the abandoned carts.
    """
    sessions = rollup(ws.events_temp, ["session_id"], {"has_purchase": "purchase"})
    carts = ws.stock_check.groupBy("session_id").agg(F.count(F.lit(1)).alias("__carts"))
    visits = (sessions.join(carts, "session_id", "left")
              .agg(F.count(F.lit(1)).alias("total_sessions"),
                   rate(F.sum(F.when(F.col("has_purchase") == 0, F.col("__carts")).otherwise(0)), F.sum("__carts"))
                   .alias("abandonment_rate")))
    v2 = traffic.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp, require_source=True, buyers=False)
    revenue = v2.agg(money_total("total_revenue").alias("total_revenue"),
                     rate(money_total("total_revenue"), F.sum("total_orders")).alias("overall_aov"))
    # Two one-row aggregates side by side: stack them (missing columns NULL) and keep each
    # column's one value with a global aggregate -- no join.
    kpis = ["total_sessions", "total_revenue", "overall_aov", "abandonment_rate"]
    return visits.unionByName(revenue, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in kpis])


def highest_risk_cards(ws: Workspace) -> DataFrame:
    """The riskiest category, session source and price tier by abandonment rate.

    Top 1 per dimension (the card is the feature); ties go to the smallest label, NULL first.
    Category is re-aggregated over stock status. One pass over the facts counts for all three
    dimensions; partial sums leave a task, one per label.
    """
    prod = ws.products.select(F.col("id").alias("__pid"), "category", "retail_price")
    facts = ws.cart_facts_sourced.join(prod, F.col("product_id") == F.col("__pid"), "left")
    known = F.col("__pid").isNotNull()  # category and tier only count carts of listed products

    def card(dimension: str, label, counts) -> Column:
        # labels of the three cards share one column: plain (binary) strings
        return F.when(counts, F.struct(F.lit(dimension).alias("dimension"), label.cast(StringType()).alias("label")))

    cards = F.array(card("category", F.col("category"), known),
                    card("traffic_source", F.col("traffic_source"), F.lit(True)),
                    card("price_tier", view_price_tier("retail_price"), known))
    counted = (facts.select("has_purchase", F.explode(cards).alias("__card")).where(F.col("__card").isNotNull())
               .groupBy(F.col("__card.dimension").alias("dimension"), F.col("__card.label").alias("label"))
               .agg(F.count(F.lit(1)).alias("times_added_to_cart"),
                    F.sum(F.when(F.col("has_purchase") == 0, 1).otherwise(0)).alias("abandoned_count"))
               .withColumn("abandonment_rate", rate("abandoned_count", "times_added_to_cart")))
    best = Window.partitionBy("dimension").orderBy(F.desc_nulls_last("abandonment_rate"), F.asc_nulls_first("label"))
    return (counted.withColumn("__place", F.row_number().over(best)).where(F.col("__place") == 1)
            .select("dimension", "label", "times_added_to_cart", "abandoned_count", "abandonment_rate"))
