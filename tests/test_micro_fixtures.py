"""Hand-made rows with known answers, one per trap of SURVEY §1.4 and per A/V difference (FIXTURES §4)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from base_helpers import make_workspace, raw_df, rows
from pyspark.sql import functions as F

from clickfold.operators import inventory, staging
from clickfold.plans import abandonment as ab
from clickfold.plans import funnel as fn
from clickfold.plans import retention as rt
from clickfold.plans import traffic as tr

USER = {"id": 1, "email": "a@x", "traffic_source": "Search", "created_at": "2020-01-01 00:00:00 UTC"}


def _order(oid, t, status="Complete", user=1):
    return {"order_id": oid, "user_id": user, "status": status, "created_at": f"2024-01-01 {t} UTC"}


# -- M1: DATEDIFF counts second boundaries; gap classes; 60-second rule -------------------------

def test_m1_boundary_gap_is_60(spark):
    ws = make_workspace(spark, users=[USER], orders=[_order(1, "00:00:00.9"), _order(2, "00:01:00.1")])
    assert rows(rt.order_gap_buckets(ws.orders_temp)) == [("1 minute - 1 hour", 1, 1)]
    assert rows(rt.repeat_rate(ws.orders_temp, ws.users_temp)) == [("Search", 1, 1, 1.0)]


def test_m1b_chain_of_quick_orders_keeps_first(spark):
    ws = make_workspace(spark, users=[USER],
                        orders=[_order(1, "00:00:00"), _order(2, "00:00:59"), _order(3, "00:01:58")])
    assert rows(rt.repeat_rate(ws.orders_temp, ws.users_temp)) == [("Search", 1, 0, 0.0)]


def test_m1c_bucket_edges(spark):
    orders = [_order(1, "00:00:00"), _order(2, "00:01:00"), _order(3, "01:01:00")]
    orders.append({"order_id": 4, "user_id": 1, "status": "Complete", "created_at": "2024-01-02 01:01:00 UTC"})
    ws = make_workspace(spark, users=[USER], orders=orders)
    assert rows(rt.order_gap_buckets(ws.orders_temp)) == [
        ("1 hour - 1 day", 1, 1), ("1 minute - 1 hour", 1, 1), ("> 1 day", 1, 1)]


def test_m1d_cancelled_removed_before_lag(spark):
    ws = make_workspace(spark, users=[USER], orders=[
        _order(1, "00:00:00"), _order(2, "00:00:30", "Cancelled"), _order(3, "00:01:10")])
    assert rows(rt.order_gap_buckets(ws.orders_temp)) == [("1 minute - 1 hour", 1, 1)]
    assert rows(rt.repeat_rate(ws.orders_temp, ws.users_temp)) == [("Search", 1, 1, 1.0)]


# -- M2: session versus (session, user) grain ---------------------------------------------------

def _event(eid, session, etype, user="7", source="Search", seq=None, uri=None, t="00:00:00", browser="Chrome"):
    return {"id": eid, "user_id": user, "session_id": session, "sequence_number": seq if seq is not None else eid,
            "event_type": etype, "traffic_source": source, "browser": browser,
            "uri": uri if uri is not None else f"/{etype}", "created_at": f"2024-01-01 {t} UTC"}


def test_m2_two_users_one_session(spark):
    ws = make_workspace(spark, events=[_event(1, "s1", "cart", "7"), _event(2, "s1", "cart", "8")])
    assert rows(tr.traffic_overview(ws.events_temp)) == [("Search", 1, 2, 2, 0, 2.0, 0.0, 0.0)]


def test_m2b_session_over_two_sources(spark):
    ws = make_workspace(spark, events=[_event(1, "s1", "cart", source="Email"),
                                       _event(2, "s1", "purchase", source="Search")])
    f = {r["traffic_source"]: r for r in fn.funnel(ws.events_temp, "traffic_source").collect()}
    assert (f["Email"]["cart_sessions"], f["Email"]["purchase_sessions"]) == (1, 0)
    assert (f["Search"]["cart_sessions"], f["Search"]["purchase_sessions"]) == (0, 1)
    assert f["Search"]["cart_to_purchase_rate"] is None
    # A18 takes MAX(traffic_source) per session: Search. Needs one mapped cart.
    cart_map = spark.createDataFrame([("s1", dt.datetime(2024, 1, 1), 1)], "session_id string, cart_time timestamp_ntz, product_id bigint")
    check = inventory.stock_check(cart_map, ws.inventory_events_temp)
    facts = ab.cart_facts(check, ws.events_temp, with_source=True)
    assert rows(ab.abandonment_by_source(facts), "traffic_source", "times_added_to_cart",
                "abandoned_count") == [("Search", 1, 0)]


def test_m2c_only_null_users(spark):
    ws = make_workspace(spark, events=[_event(1, "s1", "home", None), _event(2, "s1", "cart", None)])
    r = tr.traffic_overview(ws.events_temp).collect()[0]
    assert (r["total_sessions"], r["total_users"]) == (1, 0)


# -- M3: forward fill ---------------------------------------------------------------------------

def test_m3_forward_fill_of_product(spark):
    seq = [("cart", "/cart"), ("product", "/product/10"), ("cart", "/cart"), ("product", "/product/x"),
           ("cart", "/cart"), ("product", "/product/11"), ("home", "/home"), ("cart", "/cart")]
    events = [_event(i + 1, "s1", et, uri=u, t=f"00:00:{i:02d}") for i, (et, u) in enumerate(seq)]
    ws = make_workspace(spark, events=events)
    got = [(r["cart_time"].second, r["product_id"]) for r in
           ws.cart_product_map.orderBy("cart_time").collect()]
    assert got == [(2, 10), (4, 10), (7, 11)]


def test_m3b_product_id_only_from_product_events(spark):
    ws = make_workspace(spark, events=[_event(1, "s1", "cart", uri="/product/5"),
                                       _event(2, "s1", "product", uri="/product/6")])
    assert rows(ws.events_temp, "id", "product_id_raw") == [(1, None), (2, 6)]


# -- M4: as-of stock lookup ---------------------------------------------------------------------

def _ts(h):
    return f"2024-01-01 {h:02d}:00:00 UTC"


def _carts(spark, items):
    data = [(f"s{i}", dt.datetime(2024, 1, 1, h), p) for i, (p, h) in enumerate(items)]
    return spark.createDataFrame(data, "session_id string, cart_time timestamp_ntz, product_id bigint")


def _status(spark, inv, carts):
    ws = make_workspace(spark, inventory_events=inv)
    check = inventory.stock_check(_carts(spark, carts), ws.inventory_events_temp)
    return [r["stock_status"] for r in check.orderBy("product_id", "cart_time").collect()]


def test_m4_level_at_cart_time(spark):
    inv = [{"product_id": 10, "created_at": _ts(1), "sold_at": _ts(5)},
           {"product_id": 10, "created_at": _ts(5), "sold_at": None}]
    assert _status(spark, inv, [(10, 0), (10, 1), (10, 5)]) == ["Out of stock", "In stock", "In stock"]


def test_m4b_lookup_is_inclusive(spark):
    inv = [{"product_id": 12, "created_at": _ts(2), "sold_at": _ts(4)}]
    assert _status(spark, inv, [(12, 3), (12, 4)]) == ["In stock", "Out of stock"]


def test_m4c_no_history_and_negative_level(spark):
    inv = [{"product_id": 13, "created_at": None, "sold_at": _ts(1)}]
    assert _status(spark, inv, [(13, 2), (14, 2)]) == ["Out of stock", "Out of stock"]


def test_stock_timeline_arrivals_before_sales(spark):
    inv = [{"product_id": 1, "created_at": _ts(1), "sold_at": _ts(2)},
           {"product_id": 1, "created_at": _ts(2), "sold_at": None}]
    ws = make_workspace(spark, inventory_events=inv)
    got = rows(ws.stock_timeline, "t", "stock_level")
    assert [(t.hour, lvl) for t, lvl in got] == [(1, 1), (2, 1), (2, 2)]


# -- M5: one account per email -----------------------------------------------------------------

def test_m5_latest_account_wins(spark):
    users = [{"id": 1, "email": "a@x", "traffic_source": "Search", "created_at": "2020-05-01 00:00:00 UTC"},
             {"id": 2, "email": "a@x", "traffic_source": "Email", "created_at": "2021-05-01 00:00:00 UTC"},
             {"id": 3, "email": None, "traffic_source": "Email", "created_at": "2021-05-01 00:00:00 UTC"},
             {"id": 4, "email": None, "traffic_source": "Email", "created_at": "2022-05-01 00:00:00 UTC"},
             {"id": 5, "email": "b@x", "traffic_source": "Email", "created_at": "garbage"},
             {"id": 6, "email": "b@x", "traffic_source": "Email", "created_at": "2020-05-01 00:00:00 UTC"},
             {"id": 7, "email": "c@x", "traffic_source": "Email", "created_at": "2020-05-01 00:00:00 UTC"}]
    ws = make_workspace(spark, users=users)
    assert rows(ws.users_temp, "id", "email", "is_duplicate_account", "row_num_per_email") == [
        (2, "a@x", 1, 1), (4, None, 1, 1), (6, "b@x", 1, 1), (7, "c@x", 0, 1)]


# -- M6: order / item / user joins differ between analysis queries and views --------------------

def _rev_ws(spark):
    users = [{"id": 1, "email": "a@x", "traffic_source": "Search", "created_at": "2020-01-01 00:00:00 UTC"},
             {"id": 2, "email": "a@x", "traffic_source": "Email", "created_at": "2021-01-01 00:00:00 UTC"},
             {"id": 3, "email": "c@x", "traffic_source": "Display", "created_at": "2021-01-01 00:00:00 UTC"}]
    orders = [_order(10, "00:00:00", user=1), _order(11, "00:00:00", user=3), _order(12, "00:00:00", None, user=3)]
    items = [{"order_id": 10, "product_id": 1, "sale_price": Decimal("5.00"), "created_at": "2024-01-01 00:00:00 UTC"},
             {"order_id": 12, "product_id": 1, "sale_price": Decimal("7.00"), "created_at": "2024-01-01 00:00:00 UTC"}]
    return make_workspace(spark, users=users, orders=orders, order_items=items)


def test_m6_revenue_nulls(spark):
    ws = _rev_ws(spark)
    a3 = rows(tr.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp))
    assert a3 == [("Display", 1, 1, None, None), (None, 1, 1, 5.0, 5.0)]
    v2 = rows(tr.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp, require_source=True))
    assert v2 == [("Display", 1, 1, None, None)]
    a4 = tr.revenue_trend_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp)
    assert a4.count() == 0
    assert rt.repeat_rate(ws.orders_temp, ws.users_temp).filter(F.col("traffic_source") == "Search").count() == 0


# -- M7: item created after shipping takes the order's time ------------------------------------

def test_m7_order_item_time_fix(spark):
    orders = [{"order_id": 1, "user_id": 1, "status": "Complete", "created_at": "2024-01-01 00:00:00 UTC"}]
    items = [{"order_id": 1, "product_id": 1, "created_at": "2024-01-05 00:00:00 UTC", "shipped_at": "2024-01-03 00:00:00 UTC"},
             {"order_id": 1, "product_id": 2, "created_at": "2024-01-05 00:00:00 UTC", "shipped_at": None},
             {"order_id": 9, "product_id": 3, "created_at": "2024-01-05 00:00:00 UTC", "shipped_at": "2024-01-03 00:00:00 UTC"}]
    ws = make_workspace(spark, orders=orders, order_items=items)
    got = rows(ws.order_items_temp, "product_id", "created_date_fix")
    assert got == [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 5)), (3, None)]


# -- M8: price tiers --------------------------------------------------------------------------

def test_m8_price_tiers(spark):
    from clickfold.functions.semantics import price_tier
    df = spark.createDataFrame([(Decimal(p) if p else None,) for p in ("24.99", "25", "50", "100", None)],
                               "p decimal(12,2)")
    assert [r[0] for r in df.select(price_tier("p")).collect()] == [
        "1. < $25", "2. $25 - $50", "3. $50 - $100", "4. >= $100", "4. >= $100"]


# -- M9: product-to-cart by category -------------------------------------------------------------

def test_m9_categories_viewed_and_carted(spark):
    products = [{"id": 1, "category": "A"}, {"id": 2, "category": "B"}, {"id": 3, "category": None}]
    events = [_event(1, "s1", "product", uri="/product/1"), _event(2, "s2", "product", uri="/product/3")]
    ws = make_workspace(spark, events=events, products=products)
    cart_map = spark.createDataFrame([("s1", dt.datetime(2024, 1, 1), 2), ("s2", dt.datetime(2024, 1, 1), 3)],
                                     "session_id string, cart_time timestamp_ntz, product_id bigint")
    got = rows(fn.product_to_cart_by_category(ws.events_temp, cart_map, ws.products))
    assert got == [("A", 1, 0, 0.0), (None, 1, 0, 0.0)]


# -- M10, M11: funnel drops and abandonment per cart row ------------------------------------------

def test_m10_negative_drop(spark):
    ws = make_workspace(spark, events=[_event(1, "s1", "cart")])
    r = fn.funnel_overall(ws.events_temp).collect()[0]
    assert (r["product_to_cart_rate"], r["drop_before_cart"]) == (None, -1)


def test_m11_all_carts_of_a_buying_session_are_bought(spark):
    events = [_event(1, "s1", "product", uri="/product/1"), _event(2, "s1", "cart"), _event(3, "s1", "cart"),
              _event(4, "s1", "purchase")]
    ws = make_workspace(spark, events=events)
    assert rows(ab.abandonment_by_stock(ws.cart_facts)) == [("Out of stock", 2, 0, 0.0)]


# -- M12, M13: typed columns -------------------------------------------------------------------

def test_m12_user_id_cast(spark):
    ev = raw_df(spark, "events", [{"id": i, "user_id": u} for i, u in enumerate(["abc", "", " 12 ", "123.0"])])
    assert [r["user_id_fix"] for r in staging.stage_events(ev).orderBy("id").collect()] == [None, None, 12, None]


def test_m13_timestamp_parse(spark):
    ev = raw_df(spark, "events", [{"id": i, "created_at": c} for i, c in
                                  enumerate(["2024-01-02 03:04:05 UTC", "garbage", None])])
    got = [r["created_date_clean"] for r in staging.stage_events(ev).orderBy("id").collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None]


# -- S5/S6: optional SQL Server comparison rules ------------------------------------------------

def test_s5_tsql_collation(spark):
    from clickfold.functions.semantics import TSQL_COLLATION
    from clickfold.plans.workspace import Workspace
    users = [{"id": 1, "email": "A@x", "traffic_source": "Search", "created_at": "2020-01-01 00:00:00 utc"},
             {"id": 2, "email": "a@x ", "traffic_source": "Search", "created_at": "2021-01-01 00:00:00 UTC"}]
    orders = [_order(1, "00:00:00", "cancelled", user=2), _order(2, "00:02:00", "Complete", user=2)]
    events = [_event(1, "s1", "Cart"), _event(2, "s1", "purchase ")]
    binary = make_workspace(spark, users=users, orders=orders, events=events)
    tsql = Workspace(binary.raw, collation=TSQL_COLLATION)

    assert binary.users_temp.count() == 2
    assert rows(tsql.users_temp, "id", "is_duplicate_account") == [(2, 1)]
    assert rows(binary.users_temp, "id", "created_date_clean")[0][1] is None  # 'utc' kept under binary
    assert rows(tsql.users_temp.select("created_date_clean"))[0][0] == dt.datetime(2021, 1, 1)

    assert rt.order_gap_buckets(binary.orders_temp).count() == 1  # 'cancelled' is not 'Cancelled'
    assert tsql.orders_temp.filter(~F.col("status").isin("Cancelled", "Returned")).count() == 1

    r = fn.funnel_overall(tsql.events_temp).collect()[0]
    assert (r["cart_sessions"], r["purchase_sessions"]) == (1, 1)
    r = fn.funnel_overall(binary.events_temp).collect()[0]
    assert (r["cart_sessions"], r["purchase_sessions"]) == (0, 0)


# -- Distinct counts of two columns; the threshold of revenue at risk; optional attributes ---------

def test_distinct_counts_of_two_columns(spark):
    """Values shared by several groups, NULL keys, NULL values and a NULL-only sum."""
    from clickfold.operators.distinct import distinct_counts
    data = [("s", 1, 10, 2), ("s", 1, 11, 3), ("s", 2, 10, None), ("s", None, 10, 5), ("t", 1, None, None), (None, 1, 10, 7)]
    df = spark.createDataFrame(data, "k string, a int, b int, v int")
    out = distinct_counts(df, ["k"], {"n_a": "a", "n_b": "b"}, {"total": F.sum("v")})
    assert rows(out, "k", "n_a", "n_b", "total") == [("s", 2, 2, 10), ("t", 1, 0, None), (None, 1, 1, 7)]
    assert rows(distinct_counts(df, ["k"], {"n_b": "b"}, {})) == [("s", 2), ("t", 0), (None, 1)]
    assert rows(distinct_counts(df.limit(0), ["k"], {"n_a": "a", "n_b": "b"}, {"total": F.sum("v")})) == []


def test_an_order_id_of_two_buyers_counts_once(spark):
    ws = make_workspace(spark, users=[USER, {**USER, "id": 2, "email": "b@x"}],
                        orders=[_order(1, "00:00:00", user=1), _order(1, "00:10:00", user=2), _order(2, "00:20:00", user=2)],
                        order_items=[{"order_id": 1, "sale_price": Decimal("2.50")}, {"order_id": 2, "sale_price": Decimal("1.00")}])
    found = tr.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp)
    assert rows(found) == [("Search", 2, 2, 6.0, 3.0)]
    lean = tr.revenue_by_source(ws.orders_temp, ws.order_items_temp, ws.users_temp, buyers=False)
    assert rows(lean) == [("Search", 2, 6.0, 3.0)]


def test_revenue_at_risk_starts_at_two_hundred_rows(spark):
    """A17, V12 and D7 with the threshold of the reference: 200 abandoned rows qualify, 199 don't."""
    from clickfold.plans.catalog import QUERIES
    products = [{"id": 1, "category": "Jeans", "retail_price": Decimal("10.00")},
                {"id": 2, "category": "Socks", "retail_price": Decimal("2.00")}]
    events = []
    for product, sessions in ((1, 200), (2, 199)):
        for s in range(sessions):
            name = f"{product}-{s}"
            events += [_event(2 * len(events), name, "product", seq=1, uri=f"/product/{product}"),
                       _event(2 * len(events) + 1, name, "cart", seq=2, t="00:01:00")]
    ws = make_workspace(spark, events=events, products=products)
    for key in ("revenue_at_risk", "vw_revenue_at_risk"):
        assert rows(QUERIES[key](ws), "category", "abandoned_oos_events", "revenue_at_risk", "avg_item_price") == [
            ("Jeans", 200, 2000.0, 10.0)], key
    assert rows(QUERIES["revenue_at_risk_total"](ws), "revenue_at_risk_total", "abandoned_oos_events") == [(2000.0, 200)]


def test_optional_attributes_get_their_types(spark, tmp_path):
    """Users' and products' further attributes: typed and kept through staging, from CSV and from Parquet."""
    from clickfold.plans.workspace import Workspace
    from clickfold.sources.raw import read_raw
    users = spark.createDataFrame([("Oslo", "1", "a@x", "42", "Search", "2020-01-01 00:00:00 UTC", "x")],
                                  "City string, id string, email string, age string, traffic_source string, created_at string, note string")
    products = spark.createDataFrame([("1", "Jeans", "12.345", "Men", "20")],
                                     "id string, category string, cost string, department string, retail_price string")
    for fmt in ("csv", "parquet"):
        root = str(tmp_path / fmt)
        users.write.format(fmt).option("header", "true").save(f"{root}/users")
        products.write.format(fmt).option("header", "true").save(f"{root}/products")
        ws = Workspace(read_raw(spark, root, fmt))
        types = {f.name: f.dataType.simpleString() for f in ws.users_temp.schema.fields}
        assert (types["age"], types["city"], types["note"]) == ("int", "string", "string")
        assert rows(ws.users_temp, "id", "age", "city", "note", "is_duplicate_account") == [(1, 42, "Oslo", "x", 0)]
        assert rows(ws.products, "id", "cost", "department", "retail_price") == [
            (1, Decimal("12.35"), "Men", Decimal("20.00"))]
        assert "gender" not in types


def test_second_boundaries_before_1970(spark):
    """DATEDIFF(SECOND) counts boundaries on both sides of the epoch."""
    from clickfold.functions.semantics import seconds_between
    times = spark.createDataFrame([("1969-12-31 23:59:59.9", "1970-01-01 00:00:00.1"), ("1969-12-31 23:59:58.1", "1969-12-31 23:59:58.9"),
                                   ("1969-12-31 23:59:57.9", "1969-12-31 23:59:58.1")], "a string, b string")
    typed = times.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert [r[0] for r in typed.select(seconds_between("a", "b")).collect()] == [1, 0, 1]
