"""A run replaces what the run before wrote; files split a hot key."""

from __future__ import annotations

import os

import pytest
from base_helpers import make_workspace, rows
from pyspark.sql import functions as F

from clickfold.plans.publish import current, publish
from clickfold.plans.workspace import Workspace


def test_a_version_replaces_the_one_before_and_a_failed_one_does_not(spark, tmp_path):
    root = str(tmp_path / "out")
    assert current(spark, root) is None
    publish(spark, root, lambda folder: spark.range(3).write.parquet(folder + "/t"))
    first = current(spark, root)

    def fail(folder):
        spark.range(9).write.parquet(folder + "/t")
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        publish(spark, root, fail)
    assert current(spark, root) == first and os.listdir(root) == [os.path.basename(first)]
    assert spark.read.parquet(first + "/t").count() == 3
    assert publish(spark, root, lambda folder: spark.range(5).write.parquet(folder + "/t") or folder) == current(spark, root) != first
    assert len(os.listdir(root)) == 1 and spark.read.parquet(current(spark, root) + "/t").count() == 5


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, lambda folder: spark.range(2).write.parquet(folder + "/t"))
    left = os.path.join(root, "v00000009")
    os.makedirs(left)
    assert current(spark, root).endswith("v00000001")
    publish(spark, root, lambda folder: spark.range(4).write.parquet(folder + "/t"))
    assert os.listdir(root) == ["v00000010"]


@pytest.mark.parametrize("buckets", [None, 3])
def test_replaced_workspaces_leave_one_copy(spark, tmp_path, buckets):
    root = str(tmp_path / "ws")
    ws = make_workspace(spark, orders=[{"order_id": 1, "user_id": 1, "status": "Complete", "created_at": "2024-01-01 00:00:00 UTC"}])
    names = ("orders_temp", "products")
    tables = lambda: {t.name for t in spark.catalog.listTables(pattern="clickfold_*") if t.name.endswith("orders_temp")}
    before = tables()
    for _ in range(2):
        written = ws.replace(root, names, buckets)
    assert rows(written.orders_temp, "order_id") == [(1,)]
    assert len(os.listdir(root)) == 1 and len(tables() - before) == (1 if buckets else 0)


def test_a_hot_session_is_split_over_the_files(spark, tmp_path):
    """A third of all events in one session: no file has over twice its fair share, and the order is kept."""
    events = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 997).cast("string"))).alias("session_id"),
        F.col("id").cast("int").alias("sequence_number"), "id")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one file
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        written = Workspace(None, tables={"events_temp": events}).materialize(str(tmp_path), ("events_temp",)).events_temp
    finally:
        spark.conf.set(setting, before)
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) >= 3 and max(sizes) <= 2 * 30_000 / len(sizes)
    hot = written.where("session_id = 'hot'").groupBy(F.input_file_name()).agg(F.min("sequence_number").alias("a"), F.max("sequence_number").alias("b"))
    spans = sorted((r["a"], r["b"]) for r in hot.collect())
    assert len(spans) > 1 and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
