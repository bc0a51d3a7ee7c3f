"""Incremental staging equals batch staging, and a second run over new files only appends them."""

from __future__ import annotations

import os
import tempfile

import pytest
from base_helpers import rows
from pyspark.sql import functions as F

from clickfold.operators import staging
from clickfold.sources.testdata import raw_events, raw_orders

SF = "/root/testdata/sf0.001"


def test_stream_staging_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="clickfold-stream-")
    landing, staged, ckpt = (os.path.join(root, d) for d in ("landing", "staged", "ckpt"))
    events = raw_events(spark, SF)
    first, second = events.filter("id % 2 = 0"), events.filter("id % 2 = 1")

    from clickfold.streaming import stage_stream
    first.write.mode("append").parquet(landing)
    stage_stream(spark, "events", landing, staged, ckpt).awaitTermination()
    assert spark.read.parquet(staged).count() == first.count()

    second.write.mode("append").parquet(landing)
    stage_stream(spark, "events", landing, staged, ckpt).awaitTermination()
    assert rows(spark.read.parquet(staged)) == rows(staging.stage_events(events))


def test_stream_keeps_further_columns_with_their_types(spark):
    root = tempfile.mkdtemp(prefix="clickfold-stream-")
    for fmt in ("parquet", "csv"):
        landing, staged, ckpt = (os.path.join(root, fmt, d) for d in ("landing", "staged", "ckpt"))
        orders = raw_orders(spark, SF).withColumn("num_of_item", F.col("order_id") % 4)
        orders.write.option("header", "true").format(fmt).save(landing)

        from clickfold.streaming import stage_stream
        stage_stream(spark, "orders", landing, staged, ckpt, fmt).awaitTermination()
        got = spark.read.parquet(staged)
        assert got.schema["order_id"].dataType.simpleString() == "bigint"
        items = got.select("order_id", F.col("num_of_item").cast("long").alias("num_of_item"), "created_date_clean")
        assert rows(items) == rows(staging.stage_orders(orders).select(*items.columns))


def test_an_empty_landing_folder_has_the_declared_schema(spark):
    from clickfold.sources.schemas import RAW_SCHEMAS
    from clickfold.streaming.staging_stream import read_landing
    assert read_landing(spark, "events", tempfile.mkdtemp(prefix="clickfold-empty-")).schema == RAW_SCHEMAS["events"]


def test_tables_that_wait_for_other_rows_are_no_streams(spark):
    from clickfold.streaming import stage_stream
    for table in ("order_items", "users"):
        with pytest.raises(ValueError):
            stage_stream(spark, table, "landing", "staged", "ckpt")
