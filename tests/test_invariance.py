"""Results do not depend on partitioning or on the session time zone."""

from __future__ import annotations

from base_helpers import rows

from clickfold.plans.catalog import QUERIES
from clickfold.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"
KEYS = ("stock_check", "stock_timeline", "cart_product_map", "order_gap_buckets", "event_gap_buckets",
        "repeat_rate", "dedupe_users")


def _all(spark):
    ws = Workspace.from_testdata(spark, SF)
    return {k: rows(QUERIES[k](ws)) for k in KEYS}


def test_shuffle_partitions_do_not_matter(spark):
    base = _all(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert _all(spark) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_session_time_zone_does_not_matter(spark):
    base = _all(spark)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _all(spark) == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tsql_collation_changes_nothing_on_clean_text(spark):
    """The test tables have no case or blank variants: every key gives the same rows either way."""
    from clickfold.functions.semantics import TSQL_COLLATION
    plain = Workspace.from_testdata(spark, SF)
    tsql = Workspace(plain.raw, collation=TSQL_COLLATION)
    # one key per family, including the two that union string columns (stock check, risk cards)
    for key in ("stage_events", "dedupe_users", "stage_order_items", "stock_check", "repeat_rate",
                "revenue_trend_by_source", "traffic_overview", "funnel_by_browser", "abandonment_by_source",
                "highest_risk_cards", "product_to_cart_by_category", "channel_scorecard"):
        assert rows(QUERIES[key](tsql)) == rows(QUERIES[key](plain)), key
