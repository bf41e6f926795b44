"""Layer 4: after any sequence of state jobs the ledger still reconciles with the batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.operators.fefo import allocate
from shelfwise.plans import checks, jobs
from shelfwise.sources.tables import load

FIXTURE = __file__.rsplit("/", 1)[0] + "/fixtures/dump"
RECEIVE = ("request_id string, product_id long, batch_number string, quantity int, manufactured_date date, "
           "expiry_date date, supplier_name string, purchase_price decimal(10,2), user_id long")


def _ledger(inv):
    return {r.check_name: r.mismatches for r in checks.check_ledger(inv).collect()}


@pytest.mark.parametrize("seed", [5, 6])
def test_random_job_sequence_keeps_ledger(spark, seed):
    rnd = random.Random(seed)
    inv = load(spark, FIXTURE, fmt="csv")
    products = [r.product_id for r in inv.products.select("product_id").collect()]
    t = dt.datetime(2025, 11, 17, 10, 0)
    seq = 0
    state = checks.ledger_state(inv.movements).checkpoint()
    for step in range(6):
        t += dt.timedelta(minutes=7)                   # each run has a later "now"
        asof = AsOf.of(t.date(), t)
        kind = rnd.choice(["receive", "adjust", "dispose", "sell"])
        batch_ids = [r.batch_id for r in inv.batches.select("batch_id").collect()]
        if kind == "receive":
            rows = []
            for _ in range(3):
                seq += 1
                rows.append((f"r{seq:04d}", rnd.choice(products), f"SEQ-{seed}-{seq}", rnd.randint(1, 60), None,
                             dt.date(2027, 1, 1) + dt.timedelta(days=rnd.randint(0, 400)), None, None, 1))
            res = jobs.receive(spark.createDataFrame(rows, RECEIVE), inv, asof)
        elif kind == "adjust":
            rows = [(f"a{seq}-{i}", None, rnd.choice(batch_ids), rnd.randint(1, 9), None) for i in range(3)]
            req = spark.createDataFrame(rows, "request_id string, product_id long, batch_id string, "
                                              "added_stock int, user_id long")
            req = req.drop("product_id").join(inv.batches.select("batch_id", "product_id"), "batch_id")
            res = jobs.adjust(req, inv, asof)
        elif kind == "dispose":
            rows = [(f"d{seq}-{i}", rnd.choice(batch_ids), None, None) for i in range(2)]
            res = jobs.dispose(spark.createDataFrame(rows, "request_id string, batch_id string, reason string, "
                                                           "user_id long"), inv, asof)
        else:
            lines = [(f"s{seq}-{i}", 900 + i, 1, rnd.choice(products), 0, rnd.randint(1, 80), t.date())
                     for i in range(4)]
            d = spark.createDataFrame(lines, "sale_item_id string, sale_id long, line_no int, product_id long, "
                                             "supp_id long, quantity int, demand_date date")
            fr = allocate(d, inv.batches, asof, mode=rnd.choice(["partial", "strict"]))
            inv = inv.with_(batches=fr.batches, movements=inv.movements.unionByName(fr.movements))
            res, added = None, fr.movements
        if res is not None:
            inv, added = res.inventory, res.added["batch_movements"]
        # materialize each state so the plans stay small
        inv = inv.with_(batches=inv.batches.checkpoint(),
                        movements=inv.movements.checkpoint(), products=inv.products.checkpoint())
        assert _ledger(inv) == {"sum_vs_quantity": 0, "running_balance": 0, "orphan_movements": 0}, (step, kind)
        assert inv.batches.where("quantity < 0").count() == 0
        # The stored audit, brought forward by the job's rows alone, says the same.
        state = checks.advance_ledger(state, added, inv.movements).checkpoint()
        assert {r.check_name: r.mismatches for r in checks.check_ledger_state(state, inv.batches).collect()} == _ledger(inv)
        assert _rows(state) == _rows(checks.ledger_state(inv.movements)), (step, kind)


MOVES = ("batch_id string, movement_date timestamp, movement_id string, quantity int, remaining_quantity int, "
         "note string")


def _rows(state):
    return sorted((str(r.batch_id), r.balance, str(r["last"]), r.mismatches) for r in state.collect())


def _moves(spark, rows):
    return spark.createDataFrame([(b, None if d is None else dt.datetime(2025, 1, d), m, q, left, "x")
                                  for b, d, m, q, left in rows], MOVES)


OLD = [("a", 1, "m1", 10, 10), ("a", 2, "m2", -3, 7), ("b", 1, "m3", 5, 4), ("c", 1, "m4", None, 0), (None, 1, "m5", 2, 2)]


@pytest.mark.parametrize("new, late", [
    ([("a", 3, "m6", -7, 0), ("a", 4, "m7", 1, 9), ("d", 1, "m8", 4, 4), ("c", 2, "m9", 3, 3)], False),
    ([("a", 2, "m2x", 1, 8)], False),                        # the same instant, a later id
    ([("a", 1, "m9", 5, 15), ("d", 9, "m8", 4, 4)], True),   # between two audited rows
    ([("b", None, "m0", 5, 5), ("b", 7, "m6", 1, 11)], True),
    ([], False)])
def test_ledger_state_goes_on_from_the_last_position(spark, new, late):
    old, more = _moves(spark, OLD), _moves(spark, new)
    whole = old.unionByName(more)
    state = checks.ledger_state(old).checkpoint()
    # Without late rows the ledger is not read: here reading it is an error.
    unread = whole.withColumn("quantity", whole.quantity + F.raise_error(F.lit("ledger read")).cast("int"))
    now = checks.advance_ledger(state, more, whole if late else unread)
    assert _rows(now) == _rows(checks.ledger_state(whole))
    assert _rows(checks.advance_ledger(checks.ledger_state(old.limit(0)), whole, whole)) == _rows(now)


def test_ledger_state_forgets_deleted_batches(spark):
    old = _moves(spark, OLD)
    left = old.where("batch_id <> 'b'")
    gone = spark.createDataFrame([("b",)], "batch_id string")
    now = checks.advance_ledger(checks.ledger_state(old).checkpoint(), old.limit(0), left, touched=gone)
    assert [r[0] for r in _rows(now)] == ["None", "a", "c"]
    batches = spark.createDataFrame([("a", 7), ("c", 0)], "batch_id string, quantity int")
    assert {r.check_name: r.mismatches for r in checks.check_ledger_state(now, batches).collect()} == {
        "sum_vs_quantity": 0, "running_balance": 0, "orphan_movements": 1}
