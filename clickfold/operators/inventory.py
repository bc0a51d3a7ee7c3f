"""The cart -> product -> stock chain.

* :func:`cart_product_map`: forward fill of the last product viewed in the session onto each
  cart event (the reference's running-count ``grp`` + ``MAX OVER (session, grp)`` pair is the
  last non-NULL value so far, computed here as one scan);
* :func:`stock_timeline`: +1 per stock-in, -1 per sale, running level per product;
* :func:`stock_check`: the level at or before each cart time -- an as-of lookup. Instead of the
  reference's ``OUTER APPLY (TOP 1 ... ORDER BY t DESC)``, cart rows (delta 0) are unioned into
  the stock events and one running sum per product, ordered by ``(t, kind)`` with carts after
  stock events of the same instant, gives each cart the net level of all events with
  ``t <= cart_time``. One shuffle, linear in rows; never a nested-loop or range join.

All three scans go through :mod:`clickfold.operators.scan`, so a hot session or product is cut
into grains rather than landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import stock_status
from clickfold.operators.scan import forward_fill, running_sum


def cart_product_map(events_temp: DataFrame, clustered: bool = False) -> DataFrame:
    """``(session_id, cart_time, product_id)`` for every cart event that follows a parsed product.
    ``clustered``: the events are bucketed by session."""
    steps = (events_temp.filter(F.col("event_type").isin("product", "cart"))
             .select("session_id", "event_type", "sequence_number", "id", "created_date_clean", "product_id_raw"))
    filled = forward_fill(steps, ["session_id"], ["sequence_number", "id"], "product_id_raw", "product_id",
                          clustered=clustered, keep=["session_id", "event_type", "created_date_clean"])
    return (filled.filter((F.col("event_type") == "cart") & F.col("product_id").isNotNull())
            .select("session_id", F.col("created_date_clean").alias("cart_time"), "product_id"))


def stock_deltas(inventory_temp: DataFrame) -> DataFrame:
    """One row per stock movement: +1 at stock-in, -1 at sale; rows without a time are dropped."""
    ins = (inventory_temp.filter(F.col("created_date_clean").isNotNull())
           .select("product_id", F.col("created_date_clean").alias("t"), F.lit(1).alias("delta")))
    outs = (inventory_temp.filter(F.col("sold_date_clean").isNotNull())
            .select("product_id", F.col("sold_date_clean").alias("t"), F.lit(-1).alias("delta")))
    return ins.unionByName(outs)


def stock_timeline(inventory_temp: DataFrame) -> DataFrame:
    """``(product_id, t, stock_level)``, one row per movement.

    Within an instant arrivals come before sales (S9); rows equal in product, t and delta are
    interchangeable, so the multiset of output rows is deterministic.
    """
    levels = running_sum(stock_deltas(inventory_temp), ["product_id"], ["t", F.desc("delta")], "delta",
                         "stock_level", unit="DAY")
    return levels.select("product_id", "t", "stock_level")


def stock_check(cart_map: DataFrame, inventory_temp: DataFrame) -> DataFrame:
    """Stock status of the product at each mapped cart, one row per cart-map row.

    Level > 0 at or before the cart time -> ``In stock``; 0, negative, or no history -> ``Out of stock``.
    """
    session_type = cart_map.schema["session_id"].dataType  # keeps a collation, if any
    stock = (stock_deltas(inventory_temp).filter(F.col("product_id").isNotNull())
             .select("product_id", "t", "delta", F.lit(0).alias("kind"),
                     F.lit(None).cast(session_type).alias("session_id"),
                     F.lit(None).cast("timestamp_ntz").alias("cart_time")))
    carts = cart_map.select("product_id", F.col("cart_time").alias("t"), F.lit(0).alias("delta"),
                            F.lit(1).alias("kind"), "session_id", "cart_time")
    levels = running_sum(stock.unionByName(carts), ["product_id"], ["t", "kind"], "delta", "level", unit="DAY",
                         keep=["session_id", "product_id", "cart_time", "kind"])
    return (levels.filter(F.col("kind") == 1)
            .select("session_id", "product_id", "cart_time", stock_status("level").alias("stock_status")))
