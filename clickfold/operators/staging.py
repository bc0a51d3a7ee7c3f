"""Raw text tables -> typed, cleaned staged tables.

Each stage keeps every raw column (``SELECT *``) and appends the cleaned ones. All stages except
users and order items are narrow projections: no shuffle, codegen end to end, and any filter a
metric places above them is pushed through into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import flag, parse_utc_ts

PRODUCT_URI_ID_POS = 10  # first character after '/product/'


def stage_events(events: DataFrame) -> DataFrame:
    """Typed user id and event time; product id parsed from ``/product/<id>`` of product events."""
    uri = F.col("uri")
    product_id = F.when(
        F.col("event_type") == "product",
        uri.substr(F.lit(PRODUCT_URI_ID_POS), F.length(uri)).try_cast("bigint"),
    )
    return events.withColumns({
        "user_id_fix": F.col("user_id").try_cast("int"),
        "created_date_clean": parse_utc_ts("created_at"),
        "product_id_raw": product_id,
    })


def stage_inventory_events(inventory_events: DataFrame) -> DataFrame:
    """Typed stock-in and sale times."""
    return inventory_events.withColumns({
        "created_date_clean": parse_utc_ts("created_at"),
        "sold_date_clean": parse_utc_ts("sold_at"),
    })


def stage_orders(orders: DataFrame) -> DataFrame:
    """Four typed lifecycle times."""
    return orders.withColumns({
        "created_date_clean": parse_utc_ts("created_at"),
        "returned_date_clean": parse_utc_ts("returned_at"),
        "shipped_date_clean": parse_utc_ts("shipped_at"),
        "delivered_date_clean": parse_utc_ts("delivered_at"),
    })


def orders_not_returned(orders_temp: DataFrame) -> DataFrame:
    """Staged orders that were never returned."""
    return orders_temp.filter(F.col("returned_date_clean").isNull())


def stage_order_items(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """An item created after it shipped takes its order's creation time.

    The reference looks the order up with a correlated scalar subquery; here it is one left join
    to the orders reduced to one row per order id (the subquery would fail on a duplicate id, and
    the reduction keeps items from multiplying). The aggregation's hash partitioning on order_id
    is the one the join needs, so the orders side is shuffled once. Because the right side is
    unique on the join key, Catalyst drops the join altogether from any query that does not read
    ``created_date_fix`` (revenue reads only order_id and sale_price: one scan of two columns).
    """
    order_created = (orders.groupBy("order_id")
                     .agg(F.max(parse_utc_ts("created_at")).alias("__order_created")))
    item_cols = order_items.columns
    created = parse_utc_ts("created_at")
    shipped = parse_utc_ts("shipped_at")
    joined = order_items.join(order_created, "order_id", "left")
    return joined.select(
        *[F.col(c) for c in item_cols],
        F.when(created > shipped, F.col("__order_created")).otherwise(created).alias("created_date_fix"),
        shipped.alias("shipped_date_fix"),
        parse_utc_ts("delivered_at").alias("delivered_date_fix"),
        parse_utc_ts("returned_at").alias("returned_date_fix"),
    )


def dedupe_users(users: DataFrame) -> DataFrame:
    """P5: one account per email -- the latest created -- flagged when the email had several.

    Written as an aggregation, not ``ROW_NUMBER() = 1``: ``max_by`` and ``count`` combine
    map-side, so even one e-mail (or the NULL e-mail, S16) holding a third of all users reaches
    the reducer as one partial row per task. Ties and unparsable times: latest time first, NULL
    time last (S7), then the highest id (S8).
    """
    typed = users.withColumn("created_date_clean", parse_utc_ts("created_at"))
    cols = typed.columns
    agg = typed.groupBy("email").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct("created_date_clean", "id")).alias("__latest"),
        F.count(F.lit(1)).alias("__n"),
    )
    return agg.select(
        *[F.col("__latest")[c].alias(c) for c in cols],
        flag(F.col("__n") > 1).alias("is_duplicate_account"),
        F.lit(1).alias("row_num_per_email"),
    )
