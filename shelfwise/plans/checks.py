"""Integrity audits I-1 .. I-7. Each returns one row per check with its count.

I-1 .. I-4 are the reference's declarative constraints (keys, foreign keys, enums,
NOT NULL); I-5 .. I-7 audit rules it states or implies but never checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import labels
from shelfwise.functions.dates import AsOf
from shelfwise.operators.scan import running_sum
from shelfwise.session import cut_lineage
from shelfwise.sources import schemas
from shelfwise.sources.tables import Inventory


def _union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_unique(inv: Inventory) -> DataFrame:
    """I-1: number of key values held by more than one row, per key."""
    tables = inv.as_dict()
    rows = []
    for name, keys in schemas.UNIQUE_KEYS.items():
        for key in keys:
            dup = (tables[name].groupBy(*key).count().where(F.col("count") > 1)
                   .agg(F.count(F.lit(1)).alias("duplicate_keys")))
            rows.append(dup.select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"),
                                   "duplicate_keys"))
    return _union(rows)


def check_foreign_keys(inv: Inventory) -> DataFrame:
    """I-2: child rows whose non-NULL reference has no parent row."""
    tables = inv.as_dict()
    rows = []
    for child, col, parent, pcol in schemas.FOREIGN_KEYS:
        refs = tables[child].where(F.col(col).isNotNull()).select(F.col(col).alias("_k"))
        parents = tables[parent].select(F.col(pcol).alias("_k"))
        orphans = refs.join(parents, "_k", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
        rows.append(orphans.select(F.lit(child).alias("child_table"), F.lit(col).alias("child_column"),
                                   F.lit(parent).alias("parent_table"), "orphans"))
    return _union(rows)


def outside(col: str, domain) -> Column:
    """The value is not NULL and not in the column's enum domain."""
    return F.col(col).isNotNull() & ~F.col(col).isin(*domain)


def missing(df: DataFrame, col: str) -> Column:
    """The value is NULL and does not stand for a zero date."""
    isnull = F.col(col).isNull()
    return isnull & ~F.coalesce(F.col(f"{col}_zero"), F.lit(False)) if f"{col}_zero" in df.columns else isnull


def _tall(wide: DataFrame, table: str, cols: list[str], count: str) -> DataFrame:
    """One row per column of a one-row table of counts."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, {count})")
            .select(F.lit(table).alias("table_name"), "column_name", count))


def check_domains(inv: Inventory) -> DataFrame:
    """I-3: non-NULL values outside the column's enum domain, one scan per table."""
    rows = []
    for name, df in inv.as_dict().items():
        domains = {c: domain for table, c, domain in schemas.DOMAINS if table == name}
        if domains:
            wide = df.agg(*[F.count(F.when(outside(c, d), 1)).alias(c) for c, d in domains.items()])
            rows.append(_tall(wide, name, list(domains), "violations"))
    return _union(rows)


def check_nulls(inv: Inventory) -> DataFrame:
    """I-4: NULLs in NOT NULL columns, one scan per table (a zero date is not NULL)."""
    tables = inv.as_dict()
    rows = []
    for name, cols in schemas.NOT_NULL.items():
        wide = tables[name].agg(*[F.count(F.when(missing(tables[name], c), 1)).alias(c) for c in cols])
        rows.append(_tall(wide, name, cols, "nulls"))
    return _union(rows)


def check_ledger(inv: Inventory) -> DataFrame:
    """I-5: the ledger reconciles with the batches.

    sum_vs_quantity: batches whose movement total differs from their quantity;
    running_balance: movements whose running total (W-4, by date then id) differs from
    the recorded remaining quantity; orphan_movements: movements of unknown batches.
    """
    totals = inv.movements.groupBy("batch_id").agg(F.sum("quantity").cast("long").alias("_sum"))
    b = inv.batches.select("batch_id", "quantity")
    sums = (b.join(totals, "batch_id", "left")
            .agg(F.count(F.when(F.coalesce("_sum", F.lit(0)) != F.col("quantity"), 1)).alias("n")))
    orphans = totals.join(b, "batch_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    run = running_sum(inv.movements.select("batch_id", "movement_date", "movement_id", "quantity",
                                           "remaining_quantity"),
                      ["batch_id"], ["movement_date", "movement_id"], "quantity", "_bal")
    balance = run.agg(F.count(F.when(F.col("_bal") != F.col("remaining_quantity"), 1)).alias("n"))
    return _union([sums.select(F.lit("sum_vs_quantity").alias("check_name"), F.col("n").alias("mismatches")),
                   balance.select(F.lit("running_balance").alias("check_name"), F.col("n").alias("mismatches")),
                   orphans.select(F.lit("orphan_movements").alias("check_name"), F.col("n").alias("mismatches"))])


def _position() -> Column:
    return F.struct("movement_date", "movement_id")


def _by_batch(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on the batch, rows without one among themselves; ``other``'s key is dropped."""
    joined = df.join(other.withColumnRenamed("batch_id", "_batch"), F.col("batch_id").eqNullSafe(F.col("_batch")), how)
    return joined.drop("_batch")


def _ledger_counts(running: DataFrame) -> DataFrame:
    """Per batch: balance, last position and wrong remaining quantities of rows with their running ``_bal``."""
    return running.groupBy("batch_id").agg(
        F.sum("quantity").cast("long").alias("balance"), F.max(_position()).alias("last"),
        F.count(F.when(F.col("_bal") != F.col("remaining_quantity"), 1)).alias("mismatches"))


def _running(movements: DataFrame) -> DataFrame:
    return running_sum(movements.select("batch_id", "movement_date", "movement_id", "quantity", "remaining_quantity"),
                       ["batch_id"], ["movement_date", "movement_id"], "quantity", "_bal")


def ledger_state(movements: DataFrame) -> DataFrame:
    """W-4 to be stored: one row per batch of the ledger with its ``balance``, its ``last`` position
    (date, id) and the ``mismatches`` among its rows."""
    return _ledger_counts(_running(movements))


def advance_ledger(state: DataFrame, added: DataFrame, movements: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``ledger_state`` after the ``added`` rows, from the state before them; ``movements`` is the ledger
    with them.

    Rows after their batch's last position go on from its balance, so only they are read. A row at or
    before it (it comes late) changes balances that are already audited: its batch is counted anew from
    ``movements``, which is read only then. So are the batches of ``touched`` (``batch_id``), whose rows
    were changed or deleted; one that has no rows any more leaves the state. A row without a date sorts
    first, as in the audit of the whole ledger.
    """
    first = added.groupBy("batch_id").agg(F.min(_position()).alias("_first"))
    late = (_by_batch(first, state.select("batch_id", "last"), "inner")
            .where(F.col("_first") <= F.col("last")).select("batch_id"))
    anew = cut_lineage((late if touched is None else late.unionByName(touched.select("batch_id"))).distinct())
    recount = bool(anew.take(1))
    if recount:
        added = _by_batch(added, anew, "left_anti")
        state = _by_batch(state, anew, "left_anti")
    opening = state.select("batch_id", F.col("balance").alias("_opening"))
    onward = _by_batch(_running(added), opening, "left").withColumn(
        "_bal", F.coalesce(F.col("_bal") + F.col("_opening"), "_bal", "_opening"))
    now = (state.unionByName(_ledger_counts(onward)).groupBy("batch_id")
           .agg(F.sum("balance").alias("balance"), F.max("last").alias("last"), F.sum("mismatches").alias("mismatches")))
    if not recount:
        return now
    return now.unionByName(ledger_state(_by_batch(movements, anew, "left_semi")))


def check_ledger_state(state: DataFrame, batches: DataFrame) -> DataFrame:
    """I-5 from a stored ``ledger_state``: the rows of ``check_ledger``, without reading the ledger."""
    b = batches.select("batch_id", "quantity")
    sums = (b.join(state.select("batch_id", "balance"), "batch_id", "left")
            .agg(F.count(F.when(F.coalesce("balance", F.lit(0)) != F.col("quantity"), 1)).alias("mismatches")))
    balance = state.agg(F.coalesce(F.sum("mismatches"), F.lit(0)).alias("mismatches"))
    orphans = state.join(b, "batch_id", "left_anti").agg(F.count(F.lit(1)).alias("mismatches"))
    return _union([df.select(F.lit(name).alias("check_name"), "mismatches") for name, df in
                   (("sum_vs_quantity", sums), ("running_balance", balance), ("orphan_movements", orphans))])


def check_status(inv: Inventory, asof: AsOf) -> DataFrame:
    """I-6: stored batch status that differs from the trigger rule (C-3) at as_of."""
    diff = F.coalesce(F.col("status") != labels.batch_status(asof), F.lit(True))
    return inv.batches.agg(F.count(F.lit(1)).alias("batches"), F.count(F.when(diff, 1)).alias("mismatches"))


def check_dates(inv: Inventory) -> DataFrame:
    """I-7: manufactured after expiry, and zero dates, per table."""
    rows = []
    for name, df in (("products", inv.products), ("product_batches", inv.batches)):
        after = F.col("manufactured_date") > F.col("expiry_date")
        agg = df.agg(F.count(F.when(after, 1)).alias("manufactured_after_expiry"),
                     F.count(F.when(F.col("expiry_date_zero"), 1)).alias("zero_expiry"),
                     F.count(F.when(F.col("manufactured_date_zero"), 1)).alias("zero_manufactured"))
        rows.append(agg.selectExpr(
            f"'{name}' as table_name",
            "stack(3, 'manufactured_after_expiry', manufactured_after_expiry, 'zero_expiry', zero_expiry, "
            "'zero_manufactured', zero_manufactured) as (check_name, n)"))
    return _union(rows)
