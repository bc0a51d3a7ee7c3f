"""Identities between metrics that must hold on any data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickfold.plans.catalog import QUERIES
from clickfold.plans.workspace import Workspace

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q(spark):
    ws = Workspace.from_testdata(spark, SF).materialize()
    return lambda key: QUERIES[key](ws)


def _totals(df, count, abandoned):
    r = df.agg(F.sum(count).alias("n"), F.sum(abandoned).alias("a")).collect()[0]
    return r["n"], r["a"]


def test_category_breakdown_within_stock_totals(q):
    # inner join to products can only drop cart rows
    n16, a16 = _totals(q("abandonment_by_stock_category"), "times_added_to_cart", "abandoned_count")
    n15, a15 = _totals(q("abandonment_by_stock"), "total_carts", "abandoned_carts")
    assert n16 <= n15 and a16 <= a15


def test_source_breakdown_totals_equal_stock_totals(q):
    assert _totals(q("vw_abandonment_by_traffic"), "times_added_to_cart", "abandoned_count") == \
        _totals(q("abandonment_by_stock"), "total_carts", "abandoned_carts")


def test_funnel_view_is_funnel_plus_total(q):
    v5 = q("vw_funnel_overview").drop("total_sessions").collect()[0].asDict()
    a10 = q("funnel_overall").collect()[0].asDict()
    assert v5 == a10


def test_price_tier_view_equals_analysis_up_to_labels(q):
    a19 = {r["price_tier"][3:]: (r["times_added_to_cart"], r["abandoned_count"]) for r in
           q("abandonment_by_price_tier").collect()}
    v11 = {r["price_tier"]: (r["times_added_to_cart"], r["abandoned_count"]) for r in
           q("vw_abandonment_by_price_tier").collect()}
    assert a19 == v11


def test_abandoned_session_count(q):
    assert q("abandoned_sessions_count").collect()[0][0] == q("abandoned_sessions").count()


def test_views_equal_their_analysis_queries_where_identical(q):
    # V1, V4, V6, V7, V8, V9, V10 differ from their analysis query only in ORDER BY
    from base_helpers import rows
    for view, analysis in (("vw_traffic_overview", "traffic_overview"), ("vw_repeat_rate", "repeat_rate"),
                           ("vw_funnel_by_traffic", "funnel_by_source"), ("vw_funnel_by_browser", "funnel_by_browser"),
                           ("vw_product_to_cart_by_category", "product_to_cart_by_category"),
                           ("vw_abandonment_by_category", "abandonment_by_stock_category"),
                           ("vw_abandonment_by_traffic", "abandonment_by_source")):
        assert rows(q(view)) == rows(q(analysis)), view


def test_revenue_view_drops_only_the_null_source(q):
    from base_helpers import rows
    a3 = [r for r in rows(q("revenue_by_source")) if r[0] is not None]
    assert a3 == rows(q("vw_revenue_by_traffic"))
