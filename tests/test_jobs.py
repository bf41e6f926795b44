"""State-change jobs on the dump-shaped fixture: effects, rejects, and ledger invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.plans import checks, jobs
from shelfwise.sources.tables import load

ASOF = AsOf.of("2025-11-17", "2025-11-17 10:00:00")
FIXTURE = __file__.rsplit("/", 1)[0] + "/fixtures/dump"
RECEIVE = ("request_id string, product_id long, batch_number string, quantity int, manufactured_date date, "
           "expiry_date date, supplier_name string, purchase_price decimal(10,2), user_id long")


@pytest.fixture(scope="module")
def inv(spark):
    return load(spark, FIXTURE, fmt="csv")


def _ledger_ok(inv2):
    return {r.check_name: r.mismatches for r in checks.check_ledger(inv2).collect()} == \
        {"sum_vs_quantity": 0, "running_balance": 0, "orphan_movements": 0}


def test_receive_validates_and_updates(spark, inv):
    exp = dt.date(2028, 1, 1)
    req = spark.createDataFrame([
        ("r1", 6, " NEW-1 ", 40, None, exp, " acme ", None, 2),
        ("r2", 6, "NEW-1", 10, None, exp, None, None, 2),        # same number again in the run
        ("r3", 1, "BTH-202511-161", 5, None, exp, None, None, 2),  # exists for product 1
        ("r4", 7, "NEW-2", 0, None, exp, None, None, 2),          # invalid quantity
        ("r5", 999, "NEW-3", 5, None, exp, None, None, 2),        # unknown product
        ("r6", 8, "  ", 5, None, exp, None, None, 2),             # empty number
    ], RECEIVE)
    res = jobs.receive(req, inv, ASOF)
    rej = {r.request_id: r.reject_reason for r in res.rejects.collect()}
    assert rej == {"r2": "duplicate_in_request", "r3": "duplicate_batch", "r4": "invalid_quantity",
                   "r5": "unknown_product", "r6": "empty_batch_number"}
    new = res.added["product_batches"].collect()
    assert [(b.batch_number, b.quantity, b.original_quantity, b.status, b.supplier_name, str(b.received_date))
            for b in new] == [("NEW-1", 40, 40, "available", "acme", "2025-11-17")]
    before = inv.products.where("product_id = 6").first().current_stock
    after = res.inventory.products.where("product_id = 6").first().current_stock
    assert after == before + 40
    assert _ledger_ok(res.inventory)


def test_small_receipt_stays_available(spark, inv):
    req = spark.createDataFrame([("r1", 6, "TINY", 3, None, dt.date(2028, 1, 1), None, None, 1)], RECEIVE)
    new = jobs.receive(req, inv, ASOF).added["product_batches"].first()
    assert new.status == "available"            # the status trigger only runs on updates


def test_dispose_skips_or_replays_second_request(spark, inv):
    req = spark.createDataFrame([("d1", "2", None, 1), ("d2", "2", "damage", 1), ("d3", "nope", None, 1),
                                 ("d4", "27", None, 1)],
                                "request_id string, batch_id string, reason string, user_id long")
    res = jobs.dispose(req, inv, ASOF)
    moves = res.added["batch_movements"].collect()
    assert [(m.batch_id, m.movement_type, m.quantity, m.remaining_quantity) for m in moves] == \
        [("2", "expiry", -150, 0)]
    rej = {r.request_id: r.reject_reason for r in res.rejects.collect()}
    assert rej == {"d2": "nothing_to_dispose", "d3": "batch_not_found", "d4": "nothing_to_dispose"}
    b = res.inventory.batches.where("batch_id = '2'").first()
    assert (b.quantity, b.status) == (0, "depleted")
    assert _ledger_ok(res.inventory)
    replay = jobs.dispose(req, inv, ASOF, replay=True).added["batch_movements"].collect()
    # replay reproduces the reference: a second disposal, or one of an empty batch, writes a 0 row
    assert sorted((m.batch_id, m.quantity) for m in replay) == [("2", -150), ("2", 0), ("27", 0)]


def test_dispose_clamps_legacy_stock_at_zero(spark, inv):
    # product 1 has legacy stock 0 in the dump; disposing its batch cannot make it negative
    req = spark.createDataFrame([("d1", "2", None, None)], "request_id string, batch_id string, reason string, user_id long")
    p = jobs.dispose(req, inv, ASOF).inventory.products.where("product_id = 1").first()
    assert p.current_stock == 0


def test_adjust_running_remaining(spark, inv):
    req = spark.createDataFrame([("a1", 3, "3", 5, None), ("a2", 3, "3", 7, None), ("a3", 3, None, 4, None),
                                 ("a4", 3, "missing", 1, None)],
                                "request_id string, product_id long, batch_id string, added_stock int, user_id long")
    res = jobs.adjust(req, inv, ASOF)
    moves = sorted((m.movement_id, m.quantity, m.remaining_quantity) for m in res.added["batch_movements"].collect())
    old = inv.batches.where("batch_id = '3'").first().quantity
    assert [(q, r) for _, q, r in moves] == [(5, old + 5), (7, old + 12)]
    assert res.inventory.batches.where("batch_id = '3'").first().quantity == old + 12
    legacy = inv.products.where("product_id = 3").first().current_stock
    assert res.inventory.products.where("product_id = 3").first().current_stock == legacy + 16
    assert {r.request_id: r.reject_reason for r in res.rejects.collect()} == {"a4": "batch_not_found"}
    assert _ledger_ok(res.inventory)


def test_receive_then_dispose_restores_totals(spark, inv):
    req = spark.createDataFrame([("r1", 6, "RT-1", 25, None, dt.date(2028, 1, 1), None, None, 1)], RECEIVE)
    step1 = jobs.receive(req, inv, ASOF).inventory
    d = spark.createDataFrame([("d1", "6:RT-1", None, 1)], "request_id string, batch_id string, reason string, user_id long")
    # a later run has a later "now": the ledger orders movements by date, then id
    step2 = jobs.dispose(d, step1, AsOf.of("2025-11-17", "2025-11-17 10:05:00")).inventory
    total = lambda i: i.products.agg(F.sum("current_stock")).first()[0]
    assert total(step2) == total(inv)
    assert _ledger_ok(step2)


def test_add_update_delete_products(spark, inv):
    add = spark.createDataFrame([(2, " Zinc ", "Health & Personal Care", 9.5), (1, "Iron", " OTC ", 3.0),
                                 (3, "", "OTC", 1.0), (4, "Bad", "OTC", 0.0)],
                                "request_id long, product_name string, category string, price double")
    res = jobs.add_products(add, inv, ASOF)
    new = sorted((p.product_id, p.product_name, p.category, p.current_stock, p.reorder_level, p.reorder_quantity)
                 for p in res.added["products"].collect())
    top = inv.products.agg(F.max("product_id")).first()[0]
    assert new == [(top + 1, "Iron", "OTC", 0, 50, 100), (top + 2, "Zinc", "Health & Personal Care", 0, 50, 100)]
    assert {r.request_id: r.reject_reason for r in res.rejects.collect()} == {3: "empty_name", 4: "invalid_price"}

    upd = spark.createDataFrame([(1, 2, "Metformin XR", "Prescription Medicines", 9.0),
                                 (2, 2, "Metformin 1g", "Prescription Medicines", 10.0),
                                 (3, 404, "Ghost", "OTC", 1.0)],
                                "request_id long, product_id long, product_name string, category string, price double")
    u = jobs.update_products(upd, inv, ASOF)
    p2 = u.inventory.products.where("product_id = 2").first()
    old = inv.products.where("product_id = 2").first()
    assert (p2.product_name, float(p2.price), p2.current_stock) == ("Metformin 1g", 10.0, old.current_stock)
    assert {r.request_id: r.reject_reason for r in u.rejects.collect()} == {3: "not_found"}

    items = spark.createDataFrame([("i1", 1, 1, 3, None, 1, 1.0, 1.0, None, None)],
                                  "sale_item_id string, sale_id long, line_no int, product_id long, supp_id long, "
                                  "quantity int, unit_price double, subtotal double, demand_date date, created_at timestamp")
    from shelfwise.sources.tables import conform
    inv2 = inv.with_(sale_items=conform("sale_items", items))
    ids = spark.createDataFrame([("x1", 1), ("x2", 3), ("x3", 4040)], "request_id string, product_id long")
    dres = jobs.delete_products(ids, inv2)
    assert {r.request_id: r.reject_reason for r in dres.rejects.collect()} == {"x2": "has_sales", "x3": "not_found"}
    out = dres.inventory
    assert out.products.where("product_id = 1").count() == 0
    assert out.batches.where("product_id = 1").count() == 0
    gone = inv.batches.where("product_id = 1").select("batch_id")
    assert out.movements.join(gone, "batch_id", "left_semi").count() == 0
    assert out.products.count() == 38


def test_reclassify_ages_or_only_updated(spark, inv):
    later = AsOf.of("2028-01-01")
    aged = {r.batch_id: r.status for r in jobs.reclassify(inv.batches, later).collect()}
    assert aged["2"] == "expired" and aged["15"] == "depleted"
    only = jobs.reclassify(inv.batches, later, only=inv.batches.where("batch_id = '3'"))
    st = {r.batch_id: r.status for r in only.collect()}
    assert st["3"] == "expired" and st["2"] == "available"


def test_next_batch_numbers(spark, inv):
    req = spark.createDataFrame([("a", 6), ("b", 6), ("c", 1)], "request_id string, product_id long")
    got = {r.request_id: r.batch_number for r in jobs.next_batch_numbers(req, inv).collect()}
    n6 = inv.batches.where("product_id = 6").count()
    n1 = inv.batches.where("product_id = 1").count()
    assert got == {"a": f"BTH-6{n6 + 1:03d}", "b": f"BTH-6{n6 + 2:03d}", "c": f"BTH-1{n1 + 1:03d}"}


def test_the_ledger_audited_by_parts_is_derived_once(spark, monkeypatch):
    """Every later step reads the stored ledger; the counts are those of the audit of the whole."""
    import __spark_entry__ as entry
    from conftest import SF001
    from shelfwise.plans import checks
    from shelfwise.sources.derived import load_driver_inventory, with_faults
    asked, rested = [], entry.rested
    monkeypatch.setattr(entry, "rested", lambda df, name: asked.append(name) or rested(df, name))
    advance, seen = checks.advance_ledger, []
    monkeypatch.setattr(checks, "advance_ledger", lambda state, added, moves: seen.extend(
        d._jdf.queryExecution().optimizedPlan().toString() for d in (added, moves)) or advance(state, added, moves))
    got = {r.check_name: r.mismatches for r in entry.queries()["check_ledger_by_parts"](spark, SF001).collect()}
    whole = checks.check_ledger(with_faults(load_driver_inventory(spark, SF001)))
    assert got == {r.check_name: r.mismatches for r in whole.collect()}
    assert asked == ["ledger"] and not any("l_shipdate" in p for p in seen)
