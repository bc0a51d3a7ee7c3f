"""Order gaps and repeat purchase.

The previous order of a user comes from the skew-safe lag scan, ordered by creation time with the
order id as tie-breaker. Gaps count second boundaries like ``DATEDIFF(SECOND, ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import MIN_ORDER_GAP_SECONDS, flag, gap_bucket, rate, seconds_between, valid_order
from clickfold.operators.scan import previous_value


def order_gaps(orders_temp: DataFrame) -> DataFrame:
    """Valid orders with the creation time of the user's previous valid order."""
    orders = orders_temp.filter(valid_order()).select("user_id", "order_id", "created_date_clean")
    return previous_value(orders, ["user_id"], ["created_date_clean", "order_id"], "created_date_clean",
                          "prev_order_date")


def gap_buckets(timed: DataFrame, key: str, time_col: str, tie: str) -> DataFrame:
    """Gap of every row to the previous row of the same ``key`` in 4 classes; pairs and keys per class."""
    rows = timed.select(key, tie, time_col)
    with_prev = previous_value(rows, [key], [time_col, tie], time_col, "__prev")
    gaps = (with_prev.filter(F.col("__prev").isNotNull())
            .withColumn("gap_bucket", gap_bucket(seconds_between("__prev", time_col))))
    return gaps.groupBy("gap_bucket").agg(F.count(F.lit(1)).alias("num_order_pairs"),
                                          F.count_distinct(key).alias("num_distinct_users"))


def order_gap_buckets(orders_temp: DataFrame, ordered: bool = True) -> DataFrame:
    """How far apart consecutive valid orders of a user are (``< 1 minute`` ... ``> 1 day``)."""
    valid = orders_temp.filter(valid_order())
    out = gap_buckets(valid, "user_id", "created_date_clean", "order_id")
    return out.orderBy(F.desc("num_order_pairs")) if ordered else out


def event_gap_buckets(events_temp: DataFrame, ordered: bool = True) -> DataFrame:
    """The A6 gap classes over event times per typed user id (exercises sub-second boundaries)."""
    out = gap_buckets(events_temp, "user_id_fix", "created_date_clean", "id")
    return out.orderBy(F.desc("num_order_pairs")) if ordered else out


def repeat_rate(orders_temp: DataFrame, users_temp: DataFrame, ordered: bool = True) -> DataFrame:
    """Buyers and repeat buyers per acquisition source.

    An order placed less than 60 s after the user's immediately previous valid order is a
    technical split and is dropped (a chain of quick orders keeps only its first); buyers with
    two or more remaining orders repeat. Users removed by deduplication drop out (inner join).
    """
    gaps = order_gaps(orders_temp)
    kept = gaps.filter(F.col("prev_order_date").isNull()
                       | (seconds_between("prev_order_date", "created_date_clean") >= MIN_ORDER_GAP_SECONDS))
    user_orders = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_orders"))
    users = users_temp.select(F.col("id").alias("__user_key"), "traffic_source")
    joined = user_orders.join(users, F.col("user_id") == F.col("__user_key"), "inner")
    out = (joined.groupBy("traffic_source")
           .agg(F.count_distinct("user_id").alias("total_buyers"),
                F.sum(flag(F.col("num_orders") >= 2)).alias("repeat_buyers"))
           .withColumn("repeat_rate", rate("repeat_buyers", "total_buyers")))
    return out.orderBy(F.desc("repeat_rate")) if ordered else out
