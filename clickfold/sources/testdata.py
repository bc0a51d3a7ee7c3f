"""Mapping of the driver's generic test tables onto the six raw commerce tables (FIXTURES.md §3).

The test folder holds a generic ``events`` stream and TPC-H-like ``customer part orders lineitem``
tables. Each raw table below is a plain projection (plus one join and one per-session count) of
them, written with Spark built-ins so that it is computed in the cluster like any other stage.
The DuckDB oracle in :mod:`clickfold.oracle` derives the same tables with the same formulas.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.operators.scan import running_sum
from clickfold.sources.raw import LazyRawTables

# Fixed values of the test mapping.
SESSION_SECONDS = 172800
TRAFFIC_SOURCES = ("Search", "Organic", "Email", "Display", "Facebook")
BROWSERS = ("Chrome", "Firefox", "Safari", "IE")
EVENT_TYPES = {"view": "product", "click": "cart", "purchase": "purchase", "signup": "home", "error": "cancel"}
USER_EPOCH = "2020-01-01 00:00:00"
INVENTORY_EPOCH = "2023-12-18 00:00:00"
EPOCH = "1970-01-01 00:00:00"
TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_FMT_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _utc_text(ts: Column, fmt: str = TS_FMT) -> Column:
    return F.concat(F.date_format(ts, fmt), F.lit(" UTC"))


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _read(spark, sf_dir, "events")
    ev = source.select("event_id", "ts", "user_id", "event_type", "props")
    n_parts = _read(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    k = F.get_json_object("props", "$.k").try_cast("int")
    bucket = F.floor(F.timestamp_diff("SECOND", _ntz(EPOCH), F.col("ts")) / SESSION_SECONDS)
    ev = ev.withColumns({"__k": k, "__bucket": bucket})
    original = F.col("event_type")
    product_uri = F.concat(
        F.lit("/product/"),
        F.when(F.pmod(F.col("__k"), F.lit(10)) == 9, F.lit("x")).otherwise(F.lit("")),
        F.pmod(F.col("event_id") * 37 + F.col("__k"), n_parts).cast("string"),
    )
    mapped_type = None
    for src, dst in EVENT_TYPES.items():
        mapped_type = (F.when(original == src, F.lit(dst)) if mapped_type is None
                       else mapped_type.when(original == src, F.lit(dst)))
    ev = ev.select(
        F.col("event_id").alias("id"),
        F.when(F.pmod(F.col("event_id"), F.lit(20)) == 0, F.lit(None).cast("string"))
         .when(F.pmod(F.col("event_id"), F.lit(50)) == 1, F.lit("anon"))
         .otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("__bucket").cast("string")).alias("session_id"),
        mapped_type.alias("event_type"),
        _pick(TRAFFIC_SOURCES, F.pmod(F.col("user_id") + F.col("__bucket"), F.lit(5))).alias("traffic_source"),
        _pick(BROWSERS, F.pmod(F.col("__k"), F.lit(4))).alias("browser"),
        F.when(original == "view", product_uri).otherwise(F.concat(F.lit("/"), original)).alias("uri"),
        _utc_text(F.col("ts"), TS_FMT_MICROS).alias("created_at"),
        F.col("ts").alias("__ts"),
    )
    # The real table carries sequence_number; here it is the running count per session.
    ev = running_sum(ev, ["session_id"], ["__ts", "id"], F.lit(1), "sequence_number")
    return ev.select("id", "user_id", "session_id", F.col("sequence_number").cast("int").alias("sequence_number"),
                     "event_type", "traffic_source", "browser", "uri", "created_at")


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    email_key = F.when(F.pmod(key, F.lit(10)) == 9, key - 1).otherwise(key)
    return c.select(
        key.alias("id"),
        F.concat(F.lit("user"), email_key.cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("traffic_source"),
        _utc_text(F.timestamp_add("MINUTE", key, _ntz(USER_EPOCH))).alias("created_at"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.round((F.col("p_retailprice") - 900) * 1.5, 2).cast("decimal(12,2)").alias("retail_price"),
    )


def _order_status() -> Column:
    return (F.when(F.col("o_orderstatus") == "P", F.lit("Cancelled"))
            .when(F.col("o_orderpriority") == "1-URGENT", F.lit("Returned"))
            .when(F.col("o_orderstatus") == "F", F.lit("Complete"))
            .otherwise(F.lit("Shipped")))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    created = F.timestamp_add("SECOND", F.pmod(F.col("o_orderkey"), F.lit(7)) * 25, F.col("o_orderdate"))
    status = _order_status()
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        _utc_text(created).alias("created_at"),
        F.lit(None).cast("string").alias("shipped_at"),
        F.lit(None).cast("string").alias("delivered_at"),
        F.when(status == "Returned", _utc_text(F.timestamp_add("DAY", F.lit(5), created))).alias("returned_at"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                                                 "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("sale_price"),
        _utc_text(F.timestamp_add("DAY", F.col("l_linenumber"), F.col("o_orderdate"))).alias("created_at"),
        _utc_text(F.col("l_shipdate")).alias("shipped_at"),
        F.lit(None).cast("string").alias("delivered_at"),
        F.lit(None).cast("string").alias("returned_at"),
    )


def raw_inventory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_tax")
    created = F.timestamp_add("DAY", F.pmod(F.col("l_orderkey"), F.lit(45)), _ntz(INVENTORY_EPOCH))
    unsold = (F.col("l_tax") == 0) & (F.pmod(F.col("l_partkey"), F.lit(3)) == 0)
    sold = F.when(unsold, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), created))
    return li.select(
        F.col("l_partkey").alias("product_id"),
        _utc_text(created).alias("created_at"),
        _utc_text(sold).alias("sold_at"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> LazyRawTables:
    """The six raw tables derived from the test folder, each built when first used."""
    builders = {
        "events": raw_events,
        "orders": raw_orders,
        "order_items": raw_order_items,
        "users": raw_users,
        "products": raw_products,
        "inventory_events": raw_inventory_events,
    }
    return LazyRawTables({name: (lambda b=build: b(spark, sf_dir)) for name, build in builders.items()})
