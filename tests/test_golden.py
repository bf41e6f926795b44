"""Layer 2: the dump-shaped fixture at the dump's own date, against FIXTURES.md section 2."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.plans import checks, jobs, reports, sales
from shelfwise.operators.product_stock import batch_stats
from shelfwise.sources.tables import load

ASOF = AsOf.of("2025-11-17", "2025-11-17 10:00:00")
FIXTURE = __file__.rsplit("/", 1)[0] + "/fixtures/dump"


@pytest.fixture(scope="module")
def inv(spark):
    return load(spark, FIXTURE, fmt="csv")


def test_row_counts_and_zero_dates(inv):
    assert (inv.products.count(), inv.batches.count(), inv.movements.count()) == (39, 42, 45)
    z = inv.batches.agg(F.sum(F.col("manufactured_date_zero").cast("int")).alias("m"),
                        F.sum(F.col("expiry_date_zero").cast("int")).alias("e")).first()
    assert (z.m, z.e) == (42, 2)
    zero_ids = sorted(r.batch_id for r in inv.batches.where("expiry_date_zero").collect())
    assert zero_ids == ["54", "56"]


def test_stock_totals_per_rule(inv):
    s = batch_stats(inv.batches, ASOF).agg(*[F.sum(c).alias(c) for c in
                                             ("fresh_stock", "unexpired_stock", "allocatable_stock")]).first()
    legacy = inv.products.agg(F.sum("current_stock")).first()[0]
    assert (s.fresh_stock, s.unexpired_stock, s.allocatable_stock, legacy) == (820, 4390, 4390, 11137)


def test_fresh_by_product(inv):
    rows = batch_stats(inv.batches, ASOF).where("fresh_stock > 0").collect()
    assert {r.product_id: r.fresh_stock for r in rows} == {1: 250, 2: 100, 3: 200, 4: 100, 26: 20, 32: 50,
                                                          34: 50, 35: 50}


def test_kpis_and_status(inv):
    k = reports.inventory_kpis(inv, ASOF).first()
    assert (k.needs_reorder, k.out_of_stock, k.low_stock, k.to_dispose, k.expiring_soon) == (32, 31, 4, 31, 3)
    assert (k.inventory_status, k.inventory_colour) == ("Critical", "red")


def test_stock_bands(inv):
    counts = [reports.catalog(inv, ASOF, stock_level=lvl).count() for lvl in ("good", "low", "out")]
    assert counts == [4, 4, 31]
    assert reports.catalog(inv, ASOF, stock_level="high").count() == 39     # no rule: pass-through


def test_repurchase(inv):
    assert reports.repurchase_list(inv, ASOF).count() == 32
    t = reports.repurchase_totals(inv, ASOF).first()
    assert (t.total_items, t.total_units_needed) == (32, 3180)


def test_reorder_view(inv):
    rows = reports.reorder_list(inv, ASOF).collect()
    assert sorted((r.product_id, r.current_stock, r.quantity_needed) for r in rows) == \
        [(6, 0, 100), (16, 0, 150), (26, 20, 100)]


def test_expiring_view_only_zero_dates(inv):
    rows = reports.expiring_batches(inv, ASOF, ordered=True).collect()
    assert [(r.batch_id, r.days_until_expiry, r.urgency_level) for r in rows] == \
        [("54", None, "EXPIRED"), ("56", None, "EXPIRED")]


def test_ledger_reconciles_and_legacy_drift(inv):
    led = {r.check_name: r.mismatches for r in checks.check_ledger(inv).collect()}
    assert led == {"sum_vs_quantity": 0, "running_balance": 0, "orphan_movements": 0}
    drift = jobs.rebuild_legacy(inv).where("difference <> 0").count()
    assert drift == 38
    assert inv.movements.where("performed_by is not null").count() == 0


def test_dates_check(inv):
    bad = inv.products.where("manufactured_date > expiry_date").select("product_id").collect()
    assert sorted(r.product_id for r in bad) == [1, 46]
    d = {(r.table_name, r.check_name): r.n for r in checks.check_dates(inv).collect()}
    assert d[("products", "manufactured_after_expiry")] == 2
    assert d[("product_batches", "zero_expiry")] == 2


def test_empty_sales(inv):
    today = sales.sales_today(inv, ASOF).collect()
    assert len(today) == 1 and float(today[0].total_sales) == 0.0 and today[0].total_sales_text == "₱0.00"
    assert sales.sales_history(inv, ASOF).count() == 0


def test_zero_date_badges_and_status(inv):
    # products 20 and 45 hold the zero-dated on-hand batches: their earliest expiry is a zero date
    cat = {r.product_id: r for r in reports.catalog(inv, ASOF).collect()}
    zero_products = {r.product_id for r in inv.batches.where("expiry_date_zero").collect()}
    for pid in zero_products:
        assert cat[pid].badge == "expired"


def test_movement_types_and_statuses(inv):
    mt = {r.movement_type: r["count"] for r in inv.movements.groupBy("movement_type").count().collect()}
    assert mt == {"restock": 42, "expiry": 3}
    st = {r.status: r["count"] for r in inv.batches.groupBy("status").count().collect()}
    assert st == {"available": 40, "depleted": 2}


def test_available_stock_for_chosen_ids(spark, inv):
    ids = spark.createDataFrame([(1,), (26,), (9999,)], "product_id long")
    got = {r.product_id: r.available for r in reports.available_stock(inv, ASOF, ids).collect()}
    whole = {r.product_id: r.available for r in reports.available_stock(inv, ASOF).collect()}
    assert got == {1: whole[1], 26: whole[26], 9999: 0}
    assert sum(whole.values()) == 4390
