"""Plan checks: what Catalyst builds for the metrics."""

from __future__ import annotations

import os
import tempfile

import pytest
from base_helpers import make_workspace
from pyspark.sql import functions as F

from clickfold.plans.catalog import QUERIES
from clickfold.plans.workspace import Workspace
from clickfold.sources.raw import read_raw

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace.from_testdata(spark, SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf_and_no_nested_loop(spark, ws, key):
    plan = _plan(QUERIES[key](ws))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, f"{key}: {node}"
    assert "NestedLoopJoin" not in plan, key
    assert "CartesianProduct" not in plan, key


def _session_aggregates(df) -> list[str]:
    import re
    df.collect()
    full = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return re.findall(r"(\w+Aggregate)\(keys?=\[session_id#\d+\]", full)


def test_session_flags_share_one_aggregation(spark, ws):
    """A18's purchase flag and session source come from one per-session aggregation (partial +
    final); A15 needs no source, so its per-session aggregation stays hash-based."""
    assert len(_session_aggregates(QUERIES["abandonment_by_source"](ws))) == 2
    assert _session_aggregates(QUERIES["abandonment_by_stock"](ws)) == ["HashAggregate"] * 2


@pytest.fixture(scope="module")
def raw_dir(spark):
    """Raw tables written as files, read back with explicit schemas (the production entry point)."""
    from clickfold.sources.testdata import raw_tables
    root = tempfile.mkdtemp(prefix="clickfold-raw-")
    raw = raw_tables(spark, SF)
    for name in ("events", "orders", "order_items", "users", "products", "inventory_events"):
        getattr(raw, name).write.mode("overwrite").parquet(os.path.join(root, name))
    return root


def test_filters_and_columns_reach_the_scan(spark, raw_dir):
    ws = Workspace(read_raw(spark, raw_dir))
    plan = _plan(QUERIES["funnel_by_source"](ws))
    # only the three columns the funnel needs are read from the events files
    assert "ReadSchema: struct<session_id:string,event_type:string,traffic_source:string>" in plan
    plan = _plan(QUERIES["cart_product_map"](ws))
    assert "PushedFilters: [In(event_type, [cart,product])]" in plan


def test_raw_files_give_the_same_answers(spark, raw_dir):
    from base_helpers import rows
    from_files = Workspace(read_raw(spark, raw_dir))
    lazy = Workspace.from_testdata(spark, SF)
    for key in ("stock_check", "repeat_rate", "revenue_by_source", "product_to_cart_by_category"):
        assert rows(QUERIES[key](from_files)) == rows(QUERIES[key](lazy)), key


def test_materialized_workspace(spark):
    from base_helpers import rows
    ws = Workspace.from_testdata(spark, SF)
    written = ws.materialize(tempfile.mkdtemp(prefix="clickfold-ws-"))
    for key in ("abandonment_by_stock_category", "vw_repeat_rate", "funnel_overall"):
        assert rows(QUERIES[key](written)) == rows(QUERIES[key](ws)), key


def test_views_registered(spark):
    from clickfold.plans.catalog import register_views
    ws = make_workspace(spark)
    names = register_views(ws)
    from clickfold.plans.catalog import VIEWS, list_views
    listed = set(list_views(spark))
    assert listed == set(VIEWS) and listed <= set(names)
    assert spark.sql("SELECT * FROM vw_funnel_overview").count() == 1


def test_refresh_job_writes_the_twelve_views(spark, raw_dir):
    from base_helpers import rows

    from clickfold.plans.catalog import VIEWS
    from clickfold.plans.refresh import refresh
    out = tempfile.mkdtemp(prefix="clickfold-views-")
    written = refresh(spark, raw_dir, out)
    assert set(written) == set(VIEWS)
    lazy = Workspace(read_raw(spark, raw_dir))
    for name in ("vw_abandonment_by_category", "vw_repeat_rate", "vw_revenue_trend_by_traffic"):
        assert rows(spark.read.parquet(written[name])) == rows(VIEWS[name](lazy)), name


def test_csv_landing_folder(spark):
    """Raw tables arriving as CSV with headers read through the same explicit schemas."""
    from base_helpers import rows

    from clickfold.sources.testdata import raw_tables
    root = tempfile.mkdtemp(prefix="clickfold-csv-")
    raw = raw_tables(spark, SF)
    for name in ("events", "orders", "order_items", "users", "products", "inventory_events"):
        getattr(raw, name).write.mode("overwrite").option("header", "true").csv(os.path.join(root, name))
    from_csv = Workspace(read_raw(spark, root, "csv", {"header": "true"}))
    lazy = Workspace.from_testdata(spark, SF)
    for key in ("dedupe_users", "stock_check", "revenue_by_source", "funnel_by_browser"):
        assert rows(QUERIES[key](from_csv)) == rows(QUERIES[key](lazy)), key


def test_bucketed_materialization_avoids_shuffles(spark):
    import re

    from base_helpers import rows
    ws = Workspace.from_testdata(spark, SF)
    bucketed = ws.materialize(tempfile.mkdtemp(prefix="clickfold-bk-"), buckets=4)
    for key in ("cart_product_map", "abandonment_by_stock", "funnel_by_source", "repeat_rate",
                "revenue_by_source", "vw_abandonment_by_category"):
        assert rows(QUERIES[key](bucketed)) == rows(QUERIES[key](ws)), key
    # the forward fill computed over the bucketed events reads the session buckets in place
    over_buckets = Workspace(ws.raw, tables={"events_temp": bucketed.events_temp})
    plan = _plan(QUERIES["cart_product_map"](over_buckets))
    assert "Window" in plan and not re.search(r"Exchange hashpartitioning", plan)
    assert rows(QUERIES["cart_product_map"](over_buckets)) == rows(QUERIES["cart_product_map"](ws))


def test_cluster_conf_sizes_partitions_by_input():
    from clickfold.session import cluster_conf
    conf = cluster_conf(100 * 2 ** 40, total_cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409_600  # 100 TiB / 256 MiB
    assert int(cluster_conf(2 ** 30, total_cores=64)["spark.sql.shuffle.partitions"]) == 128


def test_slicer_narrows_every_stage(spark):
    """The site funnel over a browser-sliced workspace is that browser's row of A9."""
    from pyspark.sql import functions as F

    from clickfold.plans import funnel as fn
    ws = Workspace.from_testdata(spark, SF)
    chrome = ws.sliced(events_temp=F.col("browser") == "Chrome")
    overall = fn.funnel_overall(chrome.events_temp).collect()[0]
    by_browser = {r["browser"]: r for r in fn.funnel(ws.events_temp, "browser").collect()}["Chrome"]
    for c in ("product_view_sessions", "cart_sessions", "purchase_sessions"):
        assert overall[c] == by_browser[c], c
    # derived tables are rebuilt from the sliced events: fewer mapped carts than unsliced
    assert 0 < chrome.cart_product_map.count() < ws.cart_product_map.count()


def test_slicer_on_materialized_workspace_rebuilds_derived_tables(spark):
    from base_helpers import rows
    from pyspark.sql import functions as F
    lazy = Workspace.from_testdata(spark, SF)
    written = lazy.materialize(tempfile.mkdtemp(prefix="clickfold-ms-"))
    chrome = F.col("browser") == "Chrome"
    assert rows(QUERIES["abandonment_by_stock"](written.sliced(events_temp=chrome))) == \
        rows(QUERIES["abandonment_by_stock_chrome"](lazy))


def _reads(df) -> dict[str, int]:
    """How often the plan that ran read each raw table."""
    import collections
    import re
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return dict(collections.Counter(re.findall(r"InMemoryFileIndex\(1 paths\)\[file:[^\]]*?clickfold-raw-\w+/(\w+)", ran)))


@pytest.mark.parametrize("key, most", [
    ("cart_product_map", {"events": 1}),
    ("stock_timeline", {"inventory_events": 2}),  # one for each of the two movements
    ("stock_check", {"events": 1, "inventory_events": 2}),
    ("order_gap_buckets", {"orders": 1}),
    ("repeat_rate", {"orders": 1, "users": 1}),
    ("abandonment_by_stock", {"events": 2, "inventory_events": 2}),
    ("abandonment_by_stock_category", {"events": 2, "inventory_events": 2, "products": 1}),
    ("abandonment_by_source", {"events": 2}),
    ("overview_kpis", {"events": 2, "orders": 1, "order_items": 1, "users": 1}),
    ("highest_risk_cards", {"events": 2, "products": 1}),
    ("revenue_at_risk_total", {"events": 2, "inventory_events": 2, "products": 1}),
])
def test_scans_read_their_source_once(spark, raw_dir, key, most):
    """Both levels of a keyed scan share one exchange, nested scans too: the source is read once, and
    once more where a metric rolls the events up by session."""
    got = _reads(QUERIES[key](Workspace(read_raw(spark, raw_dir))))
    assert got and all(n <= most.get(name, 0) for name, n in got.items()), got


def test_the_levels_of_a_scan_share_an_exchange_when_columns_go_unused(spark, raw_dir):
    """Whatever part of a scan's columns is used, the two levels ask for the same ones."""
    from clickfold.operators import scan
    orders = read_raw(spark, raw_dir).orders.select("user_id", "order_id", "status", "created_at")
    orders = orders.withColumn("t", F.replace("created_at", F.lit(" UTC"), F.lit("")).cast("timestamp_ntz"))
    scanned = scan.previous_value(orders, ["user_id"], ["t", "order_id"], "status", "before")
    assert _reads(scanned.groupBy("before").count()) == {"orders": 1}


@pytest.mark.parametrize("key", ["traffic_overview", "vw_traffic_overview", "traffic_mix", "revenue_by_source",
                                 "vw_revenue_by_traffic", "vw_revenue_trend_by_traffic", "overall_aov"])
def test_distinct_counts_write_no_row_twice(spark, raw_dir, key):
    """Two distinct counts share one reduced exchange: no Expand, and the events are read once."""
    df = QUERIES[key](Workspace(read_raw(spark, raw_dir)))
    df.collect()
    plan = _plan(df)
    assert "Expand" not in plan
    if key in ("traffic_overview", "vw_traffic_overview"):
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1 and "ReusedExchange" in final
