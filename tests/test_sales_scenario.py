"""FIXTURES section 2 sales: two items, no items, same instant, larger than the stock."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.operators.fefo import allocate
from shelfwise.plans import sales
from shelfwise.sources.tables import conform, load

ASOF = AsOf.of("2025-11-17", "2025-11-17 10:00:00")
FIXTURE = __file__.rsplit("/", 1)[0] + "/fixtures/dump"
T = dt.datetime(2025, 11, 17, 9, 30)


@pytest.fixture(scope="module")
def inv(spark):
    base = load(spark, FIXTURE, fmt="csv")
    s = spark.createDataFrame([
        (101, 2, Decimal("120.00"), "cash", T),                            # two items
        (102, 2, Decimal("15.50"), "gcash", T - dt.timedelta(minutes=5)),  # no items
        (103, 3, Decimal("40.00"), "cash", T - dt.timedelta(minutes=20)),  # same instant as 104
        (104, 3, Decimal("60.25"), "cash", T - dt.timedelta(minutes=20)),
        (105, 1, Decimal("9999.99"), "cash", T - dt.timedelta(hours=2)),   # larger than the stock
        (106, 1, Decimal("1.00"), "cash", T - dt.timedelta(days=1)),       # yesterday
    ], "sale_id long, user_id long, total_amount decimal(10,2), payment_method string, sale_date timestamp")
    items = spark.createDataFrame([
        ("i1", 101, 1, 3, None, 5, ASOF.day), ("i2", 101, 2, 4, None, 7, ASOF.day),
        ("i3", 103, 1, 3, None, 2, ASOF.day), ("i4", 104, 1, 4, None, 1, ASOF.day),
        ("i5", 105, 1, 26, None, 500, ASOF.day), ("i6", 106, 1, 3, None, 1, ASOF.plus(-1)),
    ], "sale_item_id string, sale_id long, line_no int, product_id long, supp_id long, quantity int, demand_date date")
    return base.with_(sales=conform("sales", s), sale_items=conform("sale_items", items))


def test_sales_today_and_history(inv):
    today = sales.sales_today(inv, ASOF).first()
    assert today.sales_count == 5 and today.total_sales == Decimal("10235.74")
    assert today.total_sales_text == "₱10,235.74"
    hist = sales.sales_history(inv, ASOF).collect()
    assert [(r.sale_id, r.item_count) for r in hist] == [(101, 2), (102, 0), (104, 1), (103, 1), (105, 1)]
    assert hist[0].txn_id == "TXN-101" and hist[0].time_text == "09:30 AM" and hist[1].payment_label == "Gcash"


def test_feed_drops_sale_without_items(inv):
    feed = sales.activity_feed(inv, ASOF, n=4).collect()
    assert [(r.activity_type, r.sale_id, r.items_count) for r in feed] == \
        [("sale", 101, 2), ("sale", 103, 1), ("sale", 104, 1), ("sale", 105, 1)]
    assert feed[0].action == "Processed Sale" and feed[0].time_ago == "30 mins ago"
    assert feed[3].time_ago == "2 hrs ago"


def test_large_sale_partial_vs_strict(spark, inv):
    demand = inv.sale_items.where(F.col("demand_date") == F.lit(ASOF.day))
    fresh26 = inv.batches.where("product_id = 26").collect()
    stock26 = sum(b.quantity for b in fresh26 if b.status in ("available", "low_stock")
                  and b.expiry_date is not None and b.expiry_date > ASOF.day)
    part = allocate(demand, inv.batches, ASOF, "partial", products=inv.products, sale_items=inv.sale_items)
    short = {r.sale_item_id: r.short for r in part.shortfalls.collect()}
    assert short["i5"] == 500 - stock26
    assert {r.sale_item_id for r in part.allocations.collect()} >= {"i1", "i2", "i3", "i4", "i5"}
    strict = allocate(demand, inv.batches, ASOF, "strict", products=inv.products, sale_items=inv.sale_items)
    assert "i5" not in {r.sale_item_id for r in strict.allocations.collect()}
    assert {r.sale_item_id: r.short for r in strict.shortfalls.collect()}["i5"] == 500
    # legacy stock only drops for lines that were served in full
    legacy = {r.product_id: r.current_stock for r in part.products.collect()}
    before = {r.product_id: r.current_stock for r in inv.products.collect()}
    assert legacy[26] == before[26] and legacy[3] == before[3] - 7
