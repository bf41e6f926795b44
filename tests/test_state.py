"""S-5: whole versions, changes that write only their parts, recovery, counts taken while writing."""

import datetime as dt
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.plans import checks, jobs
from shelfwise.plans.allocation import allocate_sales, allocation_changes
from shelfwise.session import CLEANUP, scratch_path
from shelfwise.sources import schemas, state
from shelfwise.sources.derived import DRIVER_AS_OF, load_driver_inventory, materialize, with_faults
from shelfwise.sources.tables import Inventory, conform, load
from conftest import SF001

ASOF = AsOf.of("2025-11-17", "2025-11-17 10:00:00")
FIXTURE = __file__.rsplit("/", 1)[0] + "/fixtures/dump"


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    monkeypatch.setattr(state, "MONTH", "'m'yyyy")


@pytest.fixture(scope="module")
def inv(spark):
    return load(spark, FIXTURE, fmt="csv")


@pytest.fixture(scope="module")
def derived(spark):
    return materialize(spark, load_driver_inventory(spark, SF001, DRIVER_AS_OF), scratch_path(spark, "derived"))


def rows(inv):
    return {name: sorted(map(repr, df.collect())) for name, df in inv.as_dict().items()}


def files(spark, root, table):
    """The table's files per part."""
    out = {}
    for f in spark.read.parquet(f"{state._base(state._log(spark, root), root)}/{table}.parquet").inputFiles():
        out.setdefault(re.search("part=([^/]*)/", f)[1], set()).add(f)
    return out


def receipts(spark, n, quantity=20):
    return spark.createDataFrame(
        [(f"r{i:04d}", 1 + i % 150, f"NEW-{i}", quantity, dt.date(1998, 1, 1), dt.date(2001, 1, 1), "Sup", None, 1) for i in range(n)],
        "request_id string, product_id long, batch_number string, quantity int, manufactured_date date, expiry_date date, "
        "supplier_name string, purchase_price decimal(10,2), user_id long")


def test_versions_are_numbers_and_must_grow(spark, inv):
    root = scratch_path(spark, "state")
    state.write_state(spark, inv, root, "0009")
    smaller = inv.with_(products=inv.products.where("product_id <> 1"))
    state.write_state(spark, smaller, root, 10)
    now = state.read_state(spark, root)
    assert now.products.count() == 38 and now.batches.count() == 42
    assert load(spark, f"{root}/v=0009").products.count() == 39
    for late in (10, "9", "0010"):
        with pytest.raises(ValueError):
            state.write_state(spark, inv, root, late)
    with pytest.raises(AnalysisException):
        state.write_tables(inv, f"{root}/v=10")


def test_stored_files_hold_separate_ranges(spark, inv):
    root = scratch_path(spark, "ranges")
    state.write_tables(inv, root)
    held = (spark.read.parquet(f"{root}/batch_movements.parquet")
            .groupBy(F.input_file_name()).agg(F.min("movement_date").alias("lo"), F.max("movement_date").alias("hi"))
            .orderBy("lo").collect())
    assert all(a.hi <= b.lo for a, b in zip(held, held[1:]))


def test_a_receipt_writes_only_its_parts(spark, derived, monkeypatch):
    monkeypatch.setattr(state, "IDS_PER_PART", 100)
    root = scratch_path(spark, "receipt")
    state.write_state(spark, derived, root, 1)
    before = {t: files(spark, root, t) for t in ("products", "product_batches", "batch_movements", "sales", "sale_items", "users")}
    now = state.read_state(spark, root)
    res = jobs.receive(receipts(spark, 100).where("product_id < 90"), now, DRIVER_AS_OF)
    want = rows(res.inventory)
    done = state.write_changes(spark, root, res, 2)
    assert done.rows == {"product_batches": 89, "batch_movements": 89, "products": 89}
    assert done.violations() == {("products", "category"): 89}  # the stand-in categories are others
    after = {t: files(spark, root, t) for t in before}
    for t in ("sales", "sale_items", "users"):
        assert after[t] == before[t]
    for t in ("product_batches", "batch_movements"):  # appended to the month of the receipt; no file is written anew
        assert all(before[t][p] <= after[t][p] for p in before[t])
        assert {p for p in after[t] if after[t][p] != before[t].get(p)} == {"m1998"}
    assert {p for p in after["products"] if after["products"][p] != before["products"][p]} == {"k0"}
    assert rows(state.read_state(spark, root)) == want


def test_any_sequence_of_jobs_equals_the_tables_they_return(spark, derived):
    root = scratch_path(spark, "sequence")
    state.write_state(spark, derived, root, 1)
    later = AsOf.of("1998-07-01", "1998-07-01 09:00:00")
    steps = [
        lambda i: jobs.dispose(i.batches.where("quantity > 0 and product_id % 9 = 1").select(
            F.concat(F.lit("d"), "batch_id").alias("request_id"), "batch_id", F.lit("damage").alias("reason"),
            F.lit(1).cast("long").alias("user_id")), i, DRIVER_AS_OF),
        lambda i: jobs.receive(receipts(spark, 40), i, later),
        lambda i: allocation_changes(i, allocate_sales(i, later, start=dt.date(1998, 6, 1), end=dt.date(1998, 8, 1))),
    ]
    for n, step in enumerate(steps, 2):
        res = step(state.read_state(spark, root))
        want = rows(res.inventory)
        state.write_changes(spark, root, res, n)
        assert rows(state.read_state(spark, root)) == want, n


def test_deleting_the_last_rows_of_a_part(spark, inv):
    root = scratch_path(spark, "emptied")
    alone = inv.with_(sale_items=inv.sale_items.limit(0), sales=inv.sales.limit(0))
    state.write_state(spark, alone, root, 1)
    now = state.read_state(spark, root)
    res = jobs.delete_products(now.products.select(F.col("product_id").cast("string").alias("request_id"), "product_id"), now)
    state.write_changes(spark, root, res, 2)
    left = state.read_state(spark, root)
    assert (left.products.count(), left.batches.count(), left.movements.count()) == (0, 0, 0) and left.users.count() > 0


@pytest.mark.parametrize("died", ["before the log", "while applying"])
def test_a_writer_that_dies_leaves_a_state_that_can_be_finished(spark, derived, monkeypatch, died):
    root = scratch_path(spark, "dies")
    state.write_state(spark, derived, root, 1)
    old = rows(state.read_state(spark, root))
    res = jobs.receive(receipts(spark, 30), state.read_state(spark, root), DRIVER_AS_OF)
    want = rows(res.inventory)
    note = state._note

    def dies(spark_, root_, number, name, step):
        if step == ("staged" if died == "before the log" else "applied"):
            raise OSError("gone")
        note(spark_, root_, number, name, step)
    monkeypatch.setattr(state, "_note", dies)
    with pytest.raises(OSError):
        state.write_changes(spark, root, res, 2)
    monkeypatch.setattr(state, "_note", note)
    if died == "before the log":
        assert not state.recover(spark, root) and rows(state.read_state(spark, root)) == old
        state.write_changes(spark, root, jobs.receive(receipts(spark, 30), state.read_state(spark, root), DRIVER_AS_OF), 2)
    else:
        with pytest.raises(RuntimeError):
            state.read_state(spark, root)
        assert state.recover(spark, root) and not state.recover(spark, root)
    assert rows(state.read_state(spark, root)) == want


def test_counts_taken_while_writing_equal_the_audits(spark, derived):
    broken = with_faults(derived)
    done = state.write_state(spark, broken, scratch_path(spark, "audit"), 1)
    assert done.nulls == {(r.table_name, r.column_name): r.nulls for r in checks.check_nulls(broken).collect()}
    assert done.outside == {(r.table_name, r.column_name): r.violations for r in checks.check_domains(broken).collect()}
    assert done.rows["sales"] == broken.sales.count() and done.violations()


def test_adjustments_without_units_are_rejected(spark, inv):
    req = spark.createDataFrame([("a", 1, None, None, 1), ("b", 1, None, 4, 1)],
                                "request_id string, product_id long, batch_id string, added_stock int, user_id long")
    res = jobs.adjust(req, inv, ASOF)
    assert [(r.request_id, r.reject_reason) for r in res.rejects.collect()] == [("a", "invalid_units")]
    assert res.added["batch_movements"].count() == 0


def test_receipts_are_worked_out_once(spark):
    """Every table that a stored receipt writes reads the same rested rows: no join in their plans."""
    from shelfwise.functions.dates import AsOf
    from shelfwise.plans import jobs
    from shelfwise.sources.tables import Inventory, conform
    asof = AsOf.of("1998-06-01", "1998-06-01 10:00:00")
    empty = {n: conform(n, spark.createDataFrame([], "x int")) for n in ("product_batches", "batch_movements", "sales", "sale_items", "users")}
    products = conform("products", spark.createDataFrame([(1, 4)], "product_id long, current_stock int"))
    inv = Inventory(products, empty["product_batches"], empty["batch_movements"], empty["sales"], empty["sale_items"], empty["users"])
    asked = spark.createDataFrame([("r1", 1, "L1", 7), ("r2", 1, "L1", 9), ("r3", 2, "L2", 1)],
                                  "request_id string, product_id long, batch_number string, quantity int").selectExpr(
        "*", "date'1998-01-01' as manufactured_date", "date'2000-01-01' as expiry_date", "'s' as supplier_name",
        "cast(1 as decimal(10,2)) as purchase_price", "cast(1 as bigint) as user_id")
    lazy, once = jobs.receive(asked, inv, asof), jobs.receive(asked, inv, asof, once=True)
    for name in ("product_batches", "batch_movements"):
        assert sorted(map(str, once.added[name].collect())) == sorted(map(str, lazy.added[name].collect()))
        assert "Join" not in once.added[name]._jdf.queryExecution().optimizedPlan().toString()
    assert [r.current_stock for r in once.inventory.products.collect()] == [11]


def test_writes_drop_their_shuffle_files(spark, derived, monkeypatch):
    root, seen = scratch_path(spark, "cleaned"), []
    writer = type(derived.sales.write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda w, path, *a, **kw: seen.append((path, spark.conf.get(CLEANUP, None))) or write(w, path, *a, **kw))
    kept = spark.conf.get(CLEANUP, None)
    state.write_state(spark, derived, root, 1)
    state.write_changes(spark, root, jobs.receive(receipts(spark, 40), state.read_state(spark, root), DRIVER_AS_OF, once=True), 2)
    tables = [on for path, on in seen if path.startswith((f"{root}/v=", f"{root}/_changes")) and "/touched/" not in path]
    assert len(tables) == 12 and set(tables) == {"true"} and spark.conf.get(CLEANUP, None) == kept


def test_rows_added_to_a_part_in_use_are_not_shuffled_again(spark, derived, monkeypatch):
    root = scratch_path(spark, "as-they-lie")
    state.write_state(spark, derived, root, 1)
    res = jobs.receive(receipts(spark, 40), state.read_state(spark, root), DRIVER_AS_OF, once=True)
    want, dealt = rows(res.inventory), []
    kind = type(derived.sales)
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *by: dealt.append(by) or deal(df, *by))
    state.write_changes(spark, root, res, 2)
    assert len(dealt) == 3  # products, batches and movements as they are staged
    assert rows(state.read_state(spark, root)) == want


def test_first_receipts_are_the_same_worked_out_once(spark):
    asof = AsOf.of("1998-06-01", "1998-06-01 10:00:00")
    none = {t: spark.createDataFrame([], s) for t, s in schemas.SCHEMAS.items()}
    inv = Inventory(spark.createDataFrame([(1,), (2,)], "product_id long").transform(lambda d: conform("products", d)),
                    none["product_batches"], none["batch_movements"], none["sales"], none["sale_items"], none["users"])
    asked = spark.createDataFrame([("b", 1, "n"), ("a", 1, "n"), ("a", 1, "n"), (None, 1, "n"), (None, 2, "m"), ("c", 2, "k")],
                                  "request_id string, product_id long, batch_number string").selectExpr(
        "*", "5 as quantity", "date'1998-01-01' as manufactured_date", "date'2000-01-01' as expiry_date", "'s' as supplier_name",
        "cast(1 as decimal(10,2)) as purchase_price", "cast(1 as bigint) as user_id")
    lazy, once = jobs.receive(asked, inv, asof), jobs.receive(asked, inv, asof, once=True)
    assert sorted(map(str, once.added["product_batches"].collect())) == sorted(map(str, lazy.added["product_batches"].collect()))
    assert sorted(map(str, once.rejects.collect())) == sorted(map(str, lazy.rejects.collect()))
