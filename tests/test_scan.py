"""The two-level keyed scans equal a plain window, whatever the key distribution, and build lazily."""

from __future__ import annotations

import random

import pytest
from base_helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickfold.operators import scan


def plain(df, order, kind):
    """The window that the scan stands for."""
    w = Window.partitionBy("k").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("out", {scan.SUM: F.sum("v").over(frame), scan.FILL: F.last("v", ignorenulls=True).over(frame),
                                 scan.LAG: F.lag("v").over(w)}[kind])


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):  # one key with most rows, a NULL key, a tail of small keys, ties on t
        r = rnd.random()
        key = "hot" if r < 0.6 else (None if r < 0.7 else f"k{rnd.randint(0, 40)}")
        t = None if rnd.random() < 0.02 else rnd.randint(-50, 500)
        data.append((i, key, t, None if rnd.random() < 0.5 else rnd.randint(-3, 9)))
    return spark.createDataFrame(data, "id long, k string, t int, v int")


@pytest.mark.parametrize("kind", [scan.SUM, scan.FILL, scan.LAG])
@pytest.mark.parametrize("stretch", [1, 7, 100_000])
def test_scan_equals_window(skewed, kind, stretch):
    got = scan.keyed_scan(skewed, ["k"], ["t", "id"], "v", "out", kind, stretch=stretch)
    assert got.columns == [*skewed.columns, "out"]
    assert rows(got, "id", "out") == rows(plain(skewed, ["t", "id"], kind), "id", "out")


@pytest.mark.parametrize("unit", ["HOUR", "DAY"])
def test_times_are_cut_into_hours_or_days(skewed, unit):
    timed = skewed.withColumn("t", F.timestamp_add("MINUTE", F.col("t") * 17, F.lit("1969-12-31 12:00:00").cast("timestamp_ntz")))
    got = scan.keyed_scan(timed, ["k"], ["t", "id"], "v", "out", scan.LAG, unit)
    assert rows(got, "id", "out") == rows(plain(timed, ["t", "id"], scan.LAG), "id", "out")


def test_sum_with_descending_order_and_ties(spark):
    df = spark.createDataFrame([(i, "p", i // 10, 1 if i % 3 else -1) for i in range(400)], "id long, k string, t int, v int")
    order = ["t", F.desc("v")]
    got = scan.keyed_scan(df, ["k"], order, "v", "out", scan.SUM, stretch=4)
    # Rows tied on (t, v) are interchangeable: compare the multiset.
    assert rows(got, "t", "v", "out") == rows(plain(df, order, scan.SUM), "t", "v", "out")


_row = st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 6), st.one_of(st.none(), st.integers(-5, 5)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(_row, min_size=1, max_size=60), stretch=st.integers(1, 8), kind=st.sampled_from([scan.SUM, scan.FILL, scan.LAG]))
def test_property_scan_equals_window(spark, data, stretch, kind):
    df = spark.createDataFrame([(i, k, t, v) for i, (k, t, v) in enumerate(data)], "id long, k string, t int, v int")
    got = scan.keyed_scan(df, ["k"], ["t", "id"], "v", "out", kind, stretch=stretch)
    assert rows(got, "id", "out") == rows(plain(df, ["t", "id"], kind), "id", "out")


def test_building_queries_runs_no_job(spark):
    """Every query and view is lazy: no count, sample, checkpoint or collect while it is built."""
    from clickfold.plans.catalog import QUERIES, register_views
    from clickfold.plans.workspace import Workspace
    from clickfold.sources.schemas import RAW_SCHEMAS
    tracker = spark.sparkContext.statusTracker()
    ws = Workspace.from_testdata(spark, "/root/testdata/sf0.001")
    for name in RAW_SCHEMAS:  # opening a Parquet table reads its schema
        getattr(ws.raw, name)
    spark.sparkContext.setJobGroup("build", "building queries")
    try:
        for query in QUERIES.values():
            query(ws)
        register_views(ws)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_a_third_of_all_rows_in_one_session_and_one_product(spark):
    """One session and one product each hold a third of their tables: the chain still equals plain
    windows, and no task of the scans holds the hot key."""
    from clickfold.operators import inventory, staging
    from clickfold.sources.testdata import raw_tables
    raw = raw_tables(spark, "/root/testdata/sf0.01")
    events = staging.stage_events(raw.events).withColumn(
        "session_id", F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("session_id"))).withColumn(
        "sequence_number", F.when(F.col("id") % 3 == 0, F.col("id").cast("int")).otherwise(F.col("sequence_number")))
    steps = events.filter(F.col("event_type").isin("product", "cart")).withColumnRenamed("session_id", "k").withColumn("v", F.col("product_id_raw"))
    want = plain(steps, ["sequence_number", "id"], scan.FILL).filter((F.col("event_type") == "cart") & F.col("out").isNotNull())
    got = inventory.cart_product_map(events)
    assert rows(got, "session_id", "product_id") == rows(want, "k", "out")
    deltas = inventory.stock_deltas(staging.stage_inventory_events(raw.inventory_events)).withColumn("k", F.lit(1)).withColumn("v", F.col("delta"))
    levels = scan.running_sum(deltas.drop("v"), ["k"], ["t", F.desc("delta")], "delta", "out")
    assert rows(levels, "t", "delta", "out") == rows(plain(deltas, ["t", F.desc("delta")], scan.SUM), "t", "delta", "out")
