"""Raw input schemas (FIXTURES.md §1).

The reference has no DDL; types are inferred from how its SQL uses each column. Timestamps arrive
as text with a `` UTC`` suffix and user ids of events arrive as text, which is why staging exists.
Reading with an explicit schema (never ``inferSchema``) keeps CSV and Parquet inputs identical.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(12, 2)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


RAW_EVENTS = _schema(
    ("id", LongType()),
    ("user_id", StringType()),
    ("session_id", StringType()),
    ("sequence_number", IntegerType()),
    ("event_type", StringType()),
    ("traffic_source", StringType()),
    ("browser", StringType()),
    ("uri", StringType()),
    ("created_at", StringType()),
)

RAW_ORDERS = _schema(
    ("order_id", LongType()),
    ("user_id", LongType()),
    ("status", StringType()),
    ("created_at", StringType()),
    ("shipped_at", StringType()),
    ("delivered_at", StringType()),
    ("returned_at", StringType()),
)

RAW_ORDER_ITEMS = _schema(
    ("order_id", LongType()),
    ("product_id", LongType()),
    ("sale_price", MONEY),
    ("created_at", StringType()),
    ("shipped_at", StringType()),
    ("delivered_at", StringType()),
    ("returned_at", StringType()),
)

RAW_USERS = _schema(
    ("id", LongType()),
    ("email", StringType()),
    ("traffic_source", StringType()),
    ("created_at", StringType()),
)

RAW_PRODUCTS = _schema(
    ("id", LongType()),
    ("category", StringType()),
    ("brand", StringType()),
    ("retail_price", MONEY),
)

RAW_INVENTORY_EVENTS = _schema(
    ("product_id", LongType()),
    ("created_at", StringType()),
    ("sold_at", StringType()),
)

RAW_SCHEMAS = {
    "events": RAW_EVENTS,
    "orders": RAW_ORDERS,
    "order_items": RAW_ORDER_ITEMS,
    "users": RAW_USERS,
    "products": RAW_PRODUCTS,
    "inventory_events": RAW_INVENTORY_EVENTS,
}

#: Attributes that the tables may carry and no statement reads: typed where a source has them, else left out.
OPTIONAL_SCHEMAS = {
    "users": _schema(
        ("age", IntegerType()),
        ("gender", StringType()),
        ("city", StringType()),
        ("state", StringType()),
        ("country", StringType()),
    ),
    "products": _schema(
        ("department", StringType()),
        ("cost", MONEY),
    ),
}
