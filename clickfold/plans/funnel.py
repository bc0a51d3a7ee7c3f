"""Product -> cart -> purchase funnels (A8-A10, V5-V7) and product-to-cart by category.

Steps are independent per-session flags: no order between them is enforced, so drops can be
negative, as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import rate
from clickfold.operators.sessions import FUNNEL_STEPS, rollup


def _funnel_counts(events_temp: DataFrame, by: Sequence[str]) -> DataFrame:
    sessions = rollup(events_temp, ["session_id", *by], FUNNEL_STEPS)
    return sessions.groupBy(*by).agg(
        F.sum("step_product").alias("product_view_sessions"),
        F.sum("step_cart").alias("cart_sessions"),
        F.sum("step_purchase").alias("purchase_sessions"),
        F.count(F.lit(1)).alias("__sessions"),
    )


def funnel(events_temp: DataFrame, by: str, ordered: bool = True, order_by: str = "purchase_sessions") -> DataFrame:
    """A8 / V6 (``by='traffic_source'``), A9 / V7 (``by='browser'``): step sessions and two rates.

    A session spanning two values of ``by`` counts under each of them.
    """
    out = (_funnel_counts(events_temp, [by])
           .select(by, "product_view_sessions", "cart_sessions", "purchase_sessions",
                   rate("cart_sessions", "product_view_sessions").alias("product_to_cart_rate"),
                   rate("purchase_sessions", "cart_sessions").alias("cart_to_purchase_rate")))
    return out.orderBy(F.desc(order_by)) if ordered else out


def funnel_overall(events_temp: DataFrame, with_total: bool = False) -> DataFrame:
    """A10 / V5 (``with_total=True`` adds ``total_sessions``): whole-site funnel with drops, 1 row."""
    counts = _funnel_counts(events_temp, [])
    cols = [F.col("__sessions").alias("total_sessions")] if with_total else []
    return counts.select(
        *cols,
        "product_view_sessions", "cart_sessions", "purchase_sessions",
        (F.col("product_view_sessions") - F.col("cart_sessions")).alias("drop_before_cart"),
        (F.col("cart_sessions") - F.col("purchase_sessions")).alias("drop_after_cart"),
        rate("cart_sessions", "product_view_sessions").alias("product_to_cart_rate"),
        rate("purchase_sessions", "cart_sessions").alias("cart_to_purchase_rate"),
    )


def product_to_cart_by_category(events_temp: DataFrame, cart_map: DataFrame, products: DataFrame,
                                ordered: bool = True) -> DataFrame:
    """Sessions that viewed a category, and of those, sessions that carted it.

    The reference takes distinct (session, category) pairs of views and of carts and left-joins
    them on both keys. Here both pair sets are unioned with a marker and reduced in one
    aggregation per (session, category): one shuffle instead of two distincts and a join. A NULL
    category never matches a cart (equality on NULL fails in the join), so its cart marker is
    ignored. Products join by id; AQE broadcasts them only when their measured size allows.
    """
    cat = products.select(F.col("id").alias("__pid"), "category")
    views = (events_temp.filter((F.col("event_type") == "product") & F.col("product_id_raw").isNotNull())
             .select("session_id", F.col("product_id_raw").alias("__product"))
             .join(cat, F.col("__product") == F.col("__pid"))
             .select("session_id", "category", F.lit(1).alias("__viewed"), F.lit(0).alias("__carted")))
    carts = (cart_map.select("session_id", F.col("product_id").alias("__product"))
             .join(cat, F.col("__product") == F.col("__pid"))
             .select("session_id", "category", F.lit(0).alias("__viewed"), F.lit(1).alias("__carted")))
    pairs = (views.unionByName(carts)
             .groupBy("session_id", "category")
             .agg(F.max("__viewed").alias("__viewed"), F.max("__carted").alias("__carted"))
             .filter(F.col("__viewed") == 1))
    matched = F.col("session_id").isNotNull() & F.col("category").isNotNull() & (F.col("__carted") == 1)
    out = (pairs.groupBy("category")
           .agg(F.count("session_id").alias("product_view_sessions"),
                F.count(F.when(matched, F.col("session_id"))).alias("cart_sessions"))
           .withColumn("product_to_cart_rate", rate("cart_sessions", "product_view_sessions")))
    return out.orderBy("product_to_cart_rate") if ordered else out
