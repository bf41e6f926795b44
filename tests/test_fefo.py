"""Layer 4: FEFO allocation equals a sequential, row-by-row simulation of the procedure."""

import datetime as dt
import random

import pytest

from shelfwise.functions.dates import AsOf
from shelfwise.operators.fefo import allocate
from shelfwise.session import cut_lineage
from shelfwise.sources.tables import conform

ASOF = AsOf.of("2025-01-01", "2025-01-01 09:00:00")
DAY = dt.date(2025, 1, 1)


def _data(seed, hot_share=0.4, n_batches=120, n_lines=300):
    rnd = random.Random(seed)
    batches, lines = [], []
    for i in range(n_batches):
        pid = 1 if rnd.random() < hot_share else rnd.randint(2, 12)
        status = rnd.choice(["available", "available", "low_stock", "expired", "depleted"])
        qty = 0 if status == "depleted" else rnd.randint(1, 40)
        exp = DAY + dt.timedelta(days=rnd.randint(-30, 400))
        rec = DAY - dt.timedelta(days=rnd.randint(0, 200))
        batches.append((f"b{i:04d}", pid, f"N{i}", qty, qty, exp, rec, status))
    for j in range(n_lines):
        pid = 1 if rnd.random() < hot_share else rnd.randint(2, 14)
        sale = rnd.randint(1, 80)
        lines.append((f"s{j:05d}", sale, rnd.randint(1, 7), pid, rnd.randint(1, 5), rnd.randint(0, 25),
                      DAY + dt.timedelta(days=rnd.randint(1, 20))))
    return batches, lines


def _simulate(batches, lines, mode):
    """The procedure, one demand line after another (cursor over FEFO-ordered batches)."""
    left = {b[0]: b[3] for b in batches}
    cands = sorted((b for b in batches if b[7] in ("available", "low_stock") and b[5] > DAY and b[3] > 0),
                   key=lambda b: (b[5], b[6], b[0]))
    by_product = {}
    for b in cands:
        by_product.setdefault(b[1], []).append(b[0])
    allocs = {}
    for line in sorted(lines, key=lambda x: (x[6], x[1], x[2], x[4], x[0])):
        sid, _, _, pid, _, qty, _ = line
        if qty <= 0:
            continue
        queue = by_product.get(pid, [])
        if mode == "strict" and sum(left[b] for b in queue) < qty:
            continue
        need = qty
        for b in queue:
            if need <= 0:
                break
            take = min(left[b], need)
            if take > 0:
                left[b] -= take
                need -= take
                allocs[(sid, b)] = (take, left[b])
    return allocs


@pytest.mark.parametrize("mode,seed", [("partial", 1), ("partial", 2), ("strict", 3), ("strict", 4)])
def test_allocation_matches_sequential(spark, mode, seed):
    batches, lines = _data(seed)
    b = conform("product_batches", spark.createDataFrame(
        batches, "batch_id string, product_id long, batch_number string, quantity int, original_quantity int, "
                 "expiry_date date, received_date date, status string"))
    d = spark.createDataFrame(lines, "sale_item_id string, sale_id long, line_no int, product_id long, "
                                     "supp_id long, quantity int, demand_date date")
    res = allocate(d, b, ASOF, mode=mode)
    got = {(r.sale_item_id, r.batch_id): (r.taken, r.remaining_after) for r in res.allocations.collect()}
    want = _simulate(batches, lines, mode)
    assert got == want
    # never more than supply or demand
    after = {r.batch_id: r.quantity for r in res.batches.collect()}
    assert all(q >= 0 for q in after.values())
    taken = {}
    for (sid, _), (t, _) in got.items():
        taken[sid] = taken.get(sid, 0) + t
    demand = {x[0]: x[5] for x in lines}
    assert all(taken[s] <= demand[s] for s in taken)
    short = {r.sale_item_id: r.short for r in res.shortfalls.collect()}
    for sid, q in demand.items():
        if q > 0:
            assert short.get(sid, 0) == q - taken.get(sid, 0)


def test_ledger_reconciles_after_allocation(spark):
    """Batches and sale movements written by M-2 keep the ledger audit (I-5) clean."""
    from shelfwise.plans.checks import check_ledger
    from shelfwise.sources.tables import Inventory
    batches, lines = _data(11, hot_share=0.6)
    b = conform("product_batches", spark.createDataFrame(
        batches, "batch_id string, product_id long, batch_number string, quantity int, original_quantity int, "
                 "expiry_date date, received_date date, status string"))
    restock = conform("batch_movements", b.selectExpr(
        "concat(batch_id, ':restock') as movement_id", "batch_id", "'restock' as movement_type", "quantity",
        "quantity as remaining_quantity", "cast(received_date as timestamp) as movement_date"))
    d = spark.createDataFrame(lines, "sale_item_id string, sale_id long, line_no int, product_id long, "
                                     "supp_id long, quantity int, demand_date date")
    res = allocate(d, b, ASOF, mode="partial")
    empty = spark.createDataFrame([], "x int")
    inv = Inventory(empty, res.batches, restock.unionByName(res.movements), empty, empty, empty)
    got = {r.check_name: r.mismatches for r in check_ledger(inv).collect()}
    assert got == {"sum_vs_quantity": 0, "running_balance": 0, "orphan_movements": 0}
    assert res.movements.where("quantity >= 0").count() == 0


def _simulate_days(batches, lines, mode):
    """Day by day: candidates at each day's as-of, statuses recomputed on touched batches."""
    state = {b[0]: {"p": b[1], "q": b[3], "exp": b[5], "rec": b[6], "st": b[7]} for b in batches}
    allocs = {}
    for day in sorted({x[6] for x in lines}):
        todays = sorted((x for x in lines if x[6] == day), key=lambda x: (x[6], x[1], x[2], x[4], x[0]))
        for sid, _, _, pid, _, qty, _ in todays:
            if qty <= 0:
                continue
            queue = sorted((b for b, s in state.items() if s["p"] == pid and s["q"] > 0
                            and s["st"] in ("available", "low_stock") and s["exp"] > day),
                           key=lambda b: (state[b]["exp"], state[b]["rec"], b))
            if mode == "strict" and sum(state[b]["q"] for b in queue) < qty:
                continue
            need = qty
            for b in queue:
                if need <= 0:
                    break
                take = min(state[b]["q"], need)
                state[b]["q"] -= take
                need -= take
                allocs[(sid, b)] = (take, state[b]["q"])
        touched = {b for (s, b) in allocs if any(x[0] == s and x[6] == day for x in lines)}
        for b in touched:
            s = state[b]
            s["st"] = ("depleted" if s["q"] == 0 else "expired" if s["exp"] < day
                       else "low_stock" if s["q"] <= 10 else "available")
    return allocs


@pytest.mark.parametrize("mode", ["partial", "strict"])
def test_allocation_by_day_matches_sequential(spark, mode):
    from shelfwise.operators.fefo import allocate_by_day
    batches, lines = _data(21, hot_share=0.5, n_batches=60, n_lines=90)
    # batches that expire during the demand days
    batches = [(b[0], b[1], b[2], b[3], b[4], DAY + dt.timedelta(days=(i % 25) + 1) if i % 3 == 0 else b[5],
                b[6], b[7]) for i, b in enumerate(batches)]
    lines = [(x[0], x[1], x[2], x[3], x[4], x[5], DAY + dt.timedelta(days=(i % 6) * 4)) for i, x in enumerate(lines)]
    b = conform("product_batches", spark.createDataFrame(
        batches, "batch_id string, product_id long, batch_number string, quantity int, original_quantity int, "
                 "expiry_date date, received_date date, status string"))
    d = spark.createDataFrame(lines, "sale_item_id string, sale_id long, line_no int, product_id long, "
                                     "supp_id long, quantity int, demand_date date")
    res = allocate_by_day(d, b, mode=mode)
    got = {(r.sale_item_id, r.batch_id): (r.taken, r.remaining_after) for r in res.allocations.collect()}
    assert got == _simulate_days(batches, lines, mode)


@pytest.mark.parametrize("by_day", [False, True])
def test_long_products_are_decided_alike(spark, monkeypatch, by_day):
    """Products over the line limit go by rounds, the others in order by one task: same rows."""
    from shelfwise.operators import fefo
    batches, lines = _data(33, hot_share=0.5, n_batches=60, n_lines=120)
    b = conform("product_batches", spark.createDataFrame(
        batches, "batch_id string, product_id long, batch_number string, quantity int, original_quantity int, "
                 "expiry_date date, received_date date, status string"))
    d = spark.createDataFrame(lines, "sale_item_id string, sale_id long, line_no int, product_id long, "
                                     "supp_id long, quantity int, demand_date date")

    def run():
        res = fefo.allocate_by_day(d, b, "strict") if by_day else fefo.allocate(d, b, ASOF, "strict")
        return (sorted(map(str, res.allocations.select("sale_item_id", "batch_id", "taken", "remaining_after").collect())),
                sorted(map(str, res.decisions.select("sale_item_id", "accepted").collect())))

    one_task = run()
    monkeypatch.setattr(fefo, "LINES_PER_TASK", 20)      # product 1 alone has more
    assert run() == one_task


def test_strict_serves_in_one_shuffle(spark):
    """Lines, product keys that are null or without supply, and text keys; no join, one exchange."""
    from shelfwise.operators import fefo
    lines = spark.createDataFrame([("a", 1, 3, 0), ("a", 2, 9, 0), ("a", 3, 2, 6), ("a", 4, 2, 6), ("b", 5, 1, 0), (None, 6, 1, 0)],
                                  "product_id string, sale_item_id long, q long, floor long")
    totals = spark.createDataFrame([("a", 9), (None, 5), ("c", 4)], "product_id string, s_total long")
    out = fefo.serve_in_order(lines, totals, ["sale_item_id"])
    assert {r.sale_item_id: (r.accepted, r.d_lo) for r in out.collect()} == {
        1: (True, 0), 2: (False, None), 3: (True, 6), 4: (False, None), 5: (False, None), 6: (False, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    assert fefo.serve_in_order(lines.limit(0), totals, ["sale_item_id"]).count() == 0


def test_strict_rounds_do_not_grow_with_the_lines(spark, monkeypatch):
    """Lines 1, 20, 1, 19, 1, 18, ... on 20 units: each large line just misses."""
    from shelfwise.operators import fefo
    sizes = [q for i in range(20) for q in (1, 20 - i)]
    lines = spark.createDataFrame([(1, i, q, 0) for i, q in enumerate(sizes)],
                                  "product_id long, sale_item_id long, q long, floor long")
    totals = spark.createDataFrame([(1, 20)], "product_id long, s_total long")
    cuts = []
    monkeypatch.setattr(fefo, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    got = {r.sale_item_id: r.accepted for r in fefo.strict_accept(lines, totals, ["sale_item_id"]).collect()}
    left, want = 20, {}
    for i, q in enumerate(sizes):
        want[i] = q <= left
        left -= q if want[i] else 0
    assert got == want
    assert len(cuts) <= 1 + 6       # the start, and a round for each binary digit of 20 and one for none left


def _shelf(spark):
    batches, lines = _data(5, hot_share=0.5, n_batches=40, n_lines=60)
    return (conform("product_batches", spark.createDataFrame(
                batches, "batch_id string, product_id long, batch_number string, quantity int, original_quantity int, "
                         "expiry_date date, received_date date, status string")),
            spark.createDataFrame(lines, "sale_item_id string, sale_id long, line_no int, product_id long, "
                                         "supp_id long, quantity int, demand_date date"))


@pytest.mark.parametrize("by_day,mode", [(False, "partial"), (False, "strict"), (True, "partial"), (True, "strict")])
def test_products_a_task_can_serve_are_dealt_once(spark, monkeypatch, by_day, mode):
    """No scan by ranges and no checkpointed lines: batches and lines are dealt by product, and only the
    allocations are written. Spread over ranges, as larger products are, they give the same rows."""
    from shelfwise.operators import fefo, scan
    b, d = _shelf(spark)

    def run():
        res = (fefo.allocate_by_day(d, b, mode, sale_items=d) if by_day else fefo.allocate(d, b, ASOF, mode, sale_items=d))
        return [sorted(map(str, df.collect())) for df in
                (res.allocations.select("sale_item_id", "tag_item", "batch_id", "taken", "remaining_after"), res.shortfalls,
                 res.batches.select("batch_id", "quantity", "status"), res.decisions.select("sale_item_id", "accepted"))]

    ranged = fefo.ranged_scan
    def refuse(*args, **kwargs):
        raise AssertionError("scanned by ranges")
    monkeypatch.setattr(fefo, "ranged_scan", refuse)
    monkeypatch.setattr(scan, "ranged_scan", refuse)
    dealt = run()
    assert dealt[0]
    monkeypatch.setattr(fefo, "ranged_scan", ranged)
    monkeypatch.setattr(fefo, "LINES_PER_TASK", 10)
    assert run() == dealt
