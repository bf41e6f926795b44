"""M-2 as a job over the inventory tables: sale lines as demand, served from the batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.dates import AsOf
from shelfwise.operators.fefo import FefoResult, allocate, allocate_by_day
from shelfwise.plans.jobs import JobResult
from shelfwise.sources.tables import Inventory, conform


def demand_lines(inv: Inventory, start: dt.date | None = None, end: dt.date | None = None):
    """The sale lines, or those with a demand date in (start, end]."""
    d = F.col("demand_date")
    lines = inv.sale_items
    if start is not None:
        lines = lines.where(d > F.lit(start))
    return lines if end is None else lines.where(d <= F.lit(end))


def allocate_sales(inv: Inventory, asof: AsOf, mode: str = "partial",
                   start: dt.date | None = None, end: dt.date | None = None) -> FefoResult:
    """FEFO at one as-of day's batches; movements are tagged from the whole item table."""
    return allocate(demand_lines(inv, start, end), inv.batches, asof, mode=mode, products=inv.products,
                    sale_items=inv.sale_items, ledger=inv.movements)


def allocate_sales_by_day(inv: Inventory, mode: str = "partial",
                          start: dt.date | None = None, end: dt.date | None = None) -> FefoResult:
    """FEFO with each line served at the as-of of its own day."""
    return allocate_by_day(demand_lines(inv, start, end), inv.batches, mode=mode, products=inv.products,
                           sale_items=inv.sale_items, ledger=inv.movements)


def allocation_changes(inv: Inventory, res: FefoResult) -> JobResult:
    """An allocation as a job's result, which ``sources.state.write_changes`` can persist; what is
    short is its rejects."""
    moves = conform("batch_movements", res.movements)
    out = inv.with_(batches=res.batches, movements=inv.movements.unionByName(moves),
                    **({"products": res.products} if res.products is not None else {}))
    changed = {"product_batches": res.allocations.select("batch_id").distinct()}
    if res.products is not None:
        changed["products"] = res.allocations.select("product_id").distinct()
    rejects = res.shortfalls.select(F.col("sale_item_id").alias("request_id"), F.lit("short").alias("reject_reason"))
    return JobResult(out, {"batch_movements": moves}, rejects, changed=changed)
