"""Whole-number keys order as numbers wherever a key breaks ties (9 before 10, 99 before 100)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.operators.fefo import _tags, allocate
from shelfwise.plans import checks
from shelfwise.sources import schemas
from shelfwise.sources.tables import Inventory, conform, load

ASOF = AsOf.of("2025-01-01", "2025-01-01 09:00:00")
DAY = dt.date(2025, 1, 1)
FIXTURE = __file__.rsplit("/", 1)[0] + "/fixtures/dump"


def _batches(spark, low, high):
    rows = [(i, 1, f"N{i}", 5, 5, DAY + dt.timedelta(days=90), DAY, "available") for i in (high, low)]
    return conform("product_batches", spark.createDataFrame(
        rows, "batch_id int, product_id long, batch_number string, quantity int, original_quantity int, "
              "expiry_date date, received_date date, status string"))


@pytest.mark.parametrize("low,high", [(9, 10), (99, 100)])
def test_fefo_takes_the_smaller_number_first(spark, low, high):
    lines = conform("sale_items", spark.createDataFrame(
        [(1, 1, 1, 1, 3, DAY)], "sale_item_id int, sale_id long, line_no int, product_id long, quantity int, demand_date date")
        .withColumn("unit_price", F.lit(1)).withColumn("subtotal", F.lit(3)))
    res = allocate(lines, _batches(spark, low, high), ASOF)
    assert [r.batch_id for r in res.allocations.select("batch_id").collect()] == [low]


def test_latest_sale_item_is_the_greatest_number(spark):
    items = conform("sale_items", spark.createDataFrame(
        [(9, 1, 2, 1, 1), (10, 1, 1, 1, 1)], "sale_item_id int, sale_id long, line_no int, product_id long, quantity int"))
    assert _tags(items, items).first().tag_item == 10


def test_ledger_of_numbered_movements_balances(spark):
    when = dt.datetime(2025, 1, 1, 8)
    moves = conform("batch_movements", spark.createDataFrame(
        [(9, 1, "restock", 5, 5, when), (10, 1, "sale", -2, 3, when), (11, 1, "sale", -1, 2, when)],
        "movement_id int, batch_id int, movement_type string, quantity int, remaining_quantity int, movement_date timestamp"))
    batch = conform("product_batches", spark.createDataFrame(
        [(1, 1, "N1", 2, 5, DAY, DAY, "low_stock")],
        "batch_id int, product_id long, batch_number string, quantity int, original_quantity int, expiry_date date, "
        "received_date date, status string"))
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.SCHEMAS.items()}
    inv = Inventory(empty["products"], batch, moves, empty["sales"], empty["sale_items"], empty["users"])
    assert all(v == 0 for r in checks.check_ledger(inv).collect() for v in r.asDict().values() if isinstance(v, int))


def test_dump_keys_load_as_numbers(spark):
    inv = load(spark, FIXTURE, fmt="csv", numeric_keys=True)
    assert dict(inv.batches.dtypes)["batch_id"] == "bigint" and inv.batches.where("batch_id is null").count() == 0


def test_received_rows_continue_the_numbers_and_share_a_batch_number(spark):
    from shelfwise.plans import jobs
    inv = load(spark, FIXTURE, fmt="csv", numeric_keys=True)
    req = spark.createDataFrame(
        [("r1", 6, "LOT-7", 40), ("r2", 7, "LOT-7", 5), ("r3", 6, "LOT-7", 1)],
        "request_id string, product_id long, batch_number string, quantity int") \
        .withColumns({"manufactured_date": F.lit(None).cast("date"), "expiry_date": F.lit(dt.date(2028, 1, 1)),
                      "supplier_name": F.lit("acme"), "purchase_price": F.lit(None).cast("decimal(10,2)"),
                      "user_id": F.lit(1).cast("long")})
    res = jobs.receive(req, inv, AsOf.of("2025-11-17", "2025-11-17 10:00:00"))
    batch = inv.batches.agg(F.max("batch_id")).first()[0]
    move = inv.movements.agg(F.max("movement_id")).first()[0]
    assert sorted((b.batch_id, b.product_id) for b in res.added["product_batches"].collect()) == \
        [(batch + 1, 6), (batch + 2, 7)]
    assert sorted((m.movement_id, m.batch_id) for m in res.added["batch_movements"].collect()) == \
        [(move + 1, batch + 1), (move + 2, batch + 2)]
    assert [(r.request_id, r.reject_reason) for r in res.rejects.collect()] == [("r3", "duplicate_in_request")]


def test_allocation_movements_go_on_after_the_ledger(spark):
    lines = spark.createDataFrame([(1, 5, 1, 1, 7, 12, dt.date(2025, 1, 2))],
                                  "sale_item_id long, sale_id long, line_no int, product_id long, supp_id long, "
                                  "quantity int, demand_date date")
    ledger = spark.createDataFrame([(99, 9), (100, 10)], "movement_id long, batch_id long")
    res = allocate(lines, _batches(spark, 9, 10), ASOF, ledger=ledger)
    got = [(r.movement_id, r.batch_id) for r in res.movements.orderBy("movement_id").collect()]
    assert got == [(101, 9), (102, 10)]
