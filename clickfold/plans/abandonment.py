"""Cart abandonment.

A cart row is a row of stock check, so abandonment counts cart *events*; any purchase event in the
session marks all of its carts as bought. The reference joins a per-session purchase subquery
(and, for the source breakdown, a second per-session subquery) into every metric. Here one
aggregation per session -- ``MAX(purchase flag)``, plus ``MAX(traffic_source)`` only for the
source breakdowns -- is joined once into the **cart facts** (:func:`cart_facts`). Every metric
below is a small aggregation over the facts; a workspace can materialise them once for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import (
    OUT_OF_STOCK,
    REVENUE_AT_RISK_MIN_ROWS,
    flag,
    money_avg,
    money_sum,
    price_tier,
    rate,
    view_price_tier,
    view_price_tier_sort,
)
from clickfold.operators.sessions import rollup


def abandoned_sessions(events_temp: DataFrame) -> DataFrame:
    """(session, user, source) groups with a cart event and no purchase event."""
    status = rollup(events_temp, ["session_id", F.col("user_id_fix").alias("user_id"), "traffic_source"],
                    {"has_cart": "cart", "has_purchase": "purchase"})
    return status.filter((F.col("has_cart") == 1) & (F.col("has_purchase") == 0))


def abandoned_sessions_count(events_temp: DataFrame) -> DataFrame:
    """Number of such groups."""
    return abandoned_sessions(events_temp).agg(F.count(F.lit(1)).alias("total_abandoned_sessions"))


def cart_facts(stock_check: DataFrame, events_temp: DataFrame, with_source: bool = False) -> DataFrame:
    """Stock-check rows with the session's ``has_purchase`` (and ``traffic_source``), inner join.

    One aggregation per session supplies the columns; the sessions without a mapped cart are
    dropped by the join (AQE picks broadcast or sort-merge from the measured sizes, and splits a
    session holding many carts with its skew-join handling). The source is asked for only where
    needed: ``MAX`` of a string has no fixed-width buffer, so it turns the per-session hash
    aggregation into a sort-based one.
    """
    extra = [F.max("traffic_source").alias("traffic_source")] if with_source else []
    sessions = rollup(events_temp, ["session_id"], {"has_purchase": "purchase"}, extra)
    return stock_check.join(sessions, "session_id", "inner")


def _with_product(facts: DataFrame, products: DataFrame) -> DataFrame:
    prod = products.select(F.col("id").alias("__pid"), "category", "retail_price")
    return facts.join(prod, F.col("product_id") == F.col("__pid"), "inner")


def _abandonment(facts: DataFrame, keys, total: str, abandoned: str) -> DataFrame:
    return (facts.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias(total),
                 F.sum(flag(F.col("has_purchase") == 0)).alias(abandoned))
            .withColumn("abandonment_rate", rate(abandoned, total)))


def abandonment_by_stock(facts: DataFrame) -> DataFrame:
    """Cart rows, abandoned rows and rate per stock status."""
    return _abandonment(facts, ["stock_status"], "total_carts", "abandoned_carts")


def abandonment_by_stock_category(facts: DataFrame, products: DataFrame, ordered: bool = True) -> DataFrame:
    """The same per stock status and product category."""
    out = _abandonment(_with_product(facts, products), ["stock_status", "category"], "times_added_to_cart",
                       "abandoned_count")
    return out.orderBy("stock_status", F.desc("abandonment_rate")) if ordered else out


def revenue_at_risk(facts: DataFrame, products: DataFrame, min_rows: int = REVENUE_AT_RISK_MIN_ROWS,
                    ordered: bool = True) -> DataFrame:
    """Abandoned out-of-stock cart rows per category -- count, sum and average list
    price -- for categories with at least ``min_rows`` such rows."""
    lost = facts.filter((F.col("stock_status") == OUT_OF_STOCK) & (F.col("has_purchase") == 0))
    out = (_with_product(lost, products).groupBy("category")
           .agg(F.count(F.lit(1)).alias("abandoned_oos_events"),
                money_sum("retail_price").alias("revenue_at_risk"),
                money_avg("retail_price").alias("avg_item_price"))
           .filter(F.col("abandoned_oos_events") >= min_rows))
    return out.orderBy(F.desc("revenue_at_risk")) if ordered else out


def abandonment_by_source(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """Per session source, one source per session (``MAX(traffic_source)``).

    ``facts`` must carry the source: ``cart_facts(..., with_source=True)``."""
    out = _abandonment(facts, ["traffic_source"], "times_added_to_cart", "abandoned_count")
    return out.orderBy(F.desc("abandonment_rate")) if ordered else out


def abandonment_by_price_tier(facts: DataFrame, products: DataFrame, ordered: bool = True) -> DataFrame:
    """Per retail price tier (``1. < $25`` ... ``4. >= $100``; NULL price in the top tier)."""
    out = _abandonment(_with_product(facts, products), [price_tier("retail_price").alias("price_tier")],
                       "times_added_to_cart", "abandoned_count")
    return out.orderBy("price_tier") if ordered else out


def vw_abandonment_by_price_tier(facts: DataFrame, products: DataFrame) -> DataFrame:
    """A19 with the view's labels and a ``price_tier_sort`` key 1-4."""
    return _abandonment(_with_product(facts, products),
                        [view_price_tier("retail_price").alias("price_tier"),
                         view_price_tier_sort("retail_price").alias("price_tier_sort")],
                        "times_added_to_cart", "abandoned_count")
