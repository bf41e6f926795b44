"""Empty inputs: every operator returns an empty (or zero) result instead of failing."""

from shelfwise.functions.dates import AsOf
from shelfwise.operators.fefo import allocate
from shelfwise.operators.scan import running_sum
from shelfwise.plans import reports, sales
from shelfwise.sources.tables import Inventory, conform

ASOF = AsOf.of("2025-01-01", "2025-01-01 09:00:00")
DEMAND = ("sale_item_id string, sale_id long, line_no int, product_id long, supp_id long, quantity int, "
          "demand_date date")
BATCHES = ("batch_id string, product_id long, batch_number string, quantity int, original_quantity int, "
           "expiry_date date, received_date date, status string")


def test_allocation_with_nothing(spark):
    empty_d = spark.createDataFrame([], DEMAND)
    empty_b = conform("product_batches", spark.createDataFrame([], BATCHES))
    for mode in ("partial", "strict"):
        res = allocate(empty_d, empty_b, ASOF, mode=mode)
        assert res.allocations.count() == 0 and res.shortfalls.count() == 0


def test_demand_without_any_supply_is_all_short(spark):
    d = spark.createDataFrame([("a", 1, 1, 7, 0, 5, ASOF.day)], DEMAND)
    b = conform("product_batches", spark.createDataFrame([], BATCHES))
    for mode in ("partial", "strict"):
        res = allocate(d, b, ASOF, mode=mode)
        assert res.allocations.count() == 0
        assert [(r.sale_item_id, r.short) for r in res.shortfalls.collect()] == [("a", 5)]


def test_scan_of_empty_frame(spark):
    df = spark.createDataFrame([], "k long, o long, v long")
    assert running_sum(df, ["k"], ["o"], "v", "cum").count() == 0


def test_reports_over_empty_tables(spark):
    empty = {name: conform(name, spark.createDataFrame([], "x int").selectExpr("cast(null as int) as x").limit(0))
             for name in ("products", "product_batches", "batch_movements", "sales", "sale_items", "users")}
    inv = Inventory(empty["products"], empty["product_batches"], empty["batch_movements"], empty["sales"],
                    empty["sale_items"], empty["users"])
    k = reports.inventory_kpis(inv, ASOF).first()
    assert (k.needs_reorder, k.out_of_stock, k.to_dispose, k.inventory_status) == (0, 0, 0, "Good")
    assert sales.activity_feed(inv, ASOF, n=4).count() == 0
    assert sales.sales_today(inv, ASOF).first().sales_count == 0
    assert reports.repurchase_totals(inv, ASOF).first().total_items == 0
