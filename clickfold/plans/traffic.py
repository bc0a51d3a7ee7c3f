"""Traffic and revenue by source (A1-A5, V1-V3).

Two different traffic sources exist: the session-level one on events (A2, A5) and the
acquisition-level one on users (A1, A3, A4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import event_flag, rate, valid_order
from clickfold.operators.distinct import distinct_counts


def users_by_source(users_temp: DataFrame) -> DataFrame:
    """A1: staged users per acquisition source (the reference names the count ``num_sessions``)."""
    return users_temp.groupBy("traffic_source").agg(F.count(F.lit(1)).alias("num_sessions"))


def traffic_overview(events_temp: DataFrame, ordered: bool = True) -> DataFrame:
    """A2 / V1: sessions, users, cart and purchase sessions, and three rates per session source.

    The flags are taken per (session, user, source); a session seen under two user ids counts
    once in ``total_sessions`` but twice in the sums, exactly as in the reference.
    """
    out = (distinct_counts(events_temp, ["traffic_source"], {"total_sessions": "session_id", "total_users": "user_id_fix"},
                           {"sessions_with_cart": F.max(event_flag("cart")),
                            "sessions_with_purchase": F.max(event_flag("purchase"))})
           .withColumns({
               "session_to_cart_rate": rate("sessions_with_cart", "total_sessions"),
               "cart_to_purchase_rate": rate("sessions_with_purchase", "sessions_with_cart"),
               "conversion_rate": rate("sessions_with_purchase", "total_sessions"),
           }))
    return out.orderBy(F.desc("total_sessions")) if ordered else out


def sessions_by_source(events_temp: DataFrame) -> DataFrame:
    """Sessions per session source: the first count of A2 alone."""
    return distinct_counts(events_temp, ["traffic_source"], {"total_sessions": "session_id"}, {})


def _order_revenue(order_items_temp: DataFrame) -> DataFrame:
    """Items reduced to one row per order before any join: the sum of an order's item prices.

    Summing per order first is exact (SUM is associative on decimals, and NULL-only groups stay
    NULL), and it shrinks the join input from items to orders; the aggregation combines map-side.
    """
    return order_items_temp.groupBy("order_id").agg(F.sum("sale_price").alias("__order_revenue"))


def _sales(orders: DataFrame, keys: list[str], buyers: bool = True) -> DataFrame:
    """Orders, buyers, revenue and AOV per ``keys``; the revenue is summed as decimal and emitted once as double."""
    counted = {"total_orders": "order_id"} | ({"total_buyers": "user_id"} if buyers else {})
    return (distinct_counts(orders, keys, counted, {"total_revenue": F.sum("__order_revenue")})
            .withColumn("total_revenue", F.col("total_revenue").cast("double"))
            .withColumn("aov", rate("total_revenue", "total_orders")))


def revenue_by_source(orders_temp: DataFrame, order_items_temp: DataFrame, users_temp: DataFrame,
                      require_source: bool = False, ordered: bool = True, buyers: bool = True) -> DataFrame:
    """A3 (``require_source=False``) / V2 (``True``): valid orders, buyers, revenue and AOV per
    acquisition source. Orders without items count as orders; in A3 orders of users removed by
    deduplication form a NULL-source row, V2 drops it. Without ``buyers`` they are not counted, for
    measures that read orders and revenue only."""
    orders = orders_temp.filter(valid_order()).select("order_id", "user_id")
    users = users_temp.select(F.col("id").alias("__user_key"), "traffic_source")
    joined = (orders.join(_order_revenue(order_items_temp), "order_id", "left")
              .join(users, F.col("user_id") == F.col("__user_key"), "left"))
    if require_source:
        joined = joined.filter(F.col("traffic_source").isNotNull())
    out = _sales(joined, ["traffic_source"], buyers)
    return out.orderBy(F.desc("total_revenue")) if ordered and not require_source else out


def revenue_trend_by_source(orders_temp: DataFrame, order_items_temp: DataFrame, users_temp: DataFrame,
                            require_source: bool = False, ordered: bool = True) -> DataFrame:
    """A4 / V3: the same per calendar month of the order, with inner joins (orders without items
    and orders of removed users vanish)."""
    created = F.col("created_date_clean")
    orders = (orders_temp.filter(valid_order())
              .select("order_id", "user_id",
                      F.make_date(F.year(created), F.month(created), F.lit(1)).alias("year_month"),
                      F.year(created).alias("year"), F.month(created).alias("month")))
    users = users_temp.select(F.col("id").alias("__user_key"), "traffic_source")
    joined = (orders.join(_order_revenue(order_items_temp), "order_id", "inner")
              .join(users, F.col("user_id") == F.col("__user_key"), "inner"))
    if require_source:
        joined = joined.filter(F.col("traffic_source").isNotNull())
    out = _sales(joined, ["year_month", "year", "month", "traffic_source"])
    return out.orderBy("year_month", "traffic_source") if ordered and not require_source else out


def sessions_trend_by_source(events_temp: DataFrame, ordered: bool = True) -> DataFrame:
    """A5: sessions and purchasing sessions per month of the event and session source.

    ``COUNT(DISTINCT session)`` and ``COUNT(DISTINCT CASE purchase THEN session END)`` are
    computed as two aggregation levels (per session, then per group) instead of an Expand of
    every event row.
    """
    created = F.col("created_date_clean")
    keys = [F.make_date(F.year(created), F.month(created), F.lit(1)).alias("year_month"),
            F.year(created).alias("year"), F.month(created).alias("month"), F.col("traffic_source")]
    per_session = (events_temp.groupBy(*keys, "session_id")
                   .agg(F.max(event_flag("purchase")).alias("__purchase")))
    out = (per_session.groupBy("year_month", "year", "month", "traffic_source")
           .agg(F.count("session_id").alias("sessions"),
                F.count(F.when(F.col("__purchase") == 1, F.col("session_id"))).alias("purchase_sessions")))
    return out.orderBy("year_month", F.desc("sessions")) if ordered else out
