"""M-2: first-expiry-first-out allocation of demand lines to batches, set-based.

The reference drains batches one demand call at a time with a cursor. Because batches
form a queue of fixed order per product, sequential draining equals the overlap of two
families of intervals on the product's supply line: batch ``b`` covers ``[s_lo, s_hi)``,
demand line ``d`` covers ``[d_lo, d_hi)``, and ``d`` takes
``min(s_hi, d_hi) - max(s_lo, d_lo)`` units from ``b`` when that is positive.

At one as-of day the intervals are running sums. Day by day, batches expire between the
lines: a line starts where the line before it ended, or after the last unit that has
expired by its day (its ``floor``), whichever is later. Queue order is expiry order, so the
expired units are always a prefix, and ``d_hi = max(d_hi of the line before, floor) + q``
solves to a running sum plus a running maximum: no loop over days or lines.

Matching intervals is done by a sweep, not by a join on product (which would test all
pairs of a product): supply starts and demand starts are merged in position order and
each start carries forward the interval of the other side that contains it. Every
overlapping pair starts at exactly one of these starts, so the output is linear in the
input. The batches and lines of all products are dealt to tasks by product once, and every running
value is a window over what a task has (``_by_product``). The batches and lines of a product of more than
``LINES_PER_TASK`` rows are spread over all tasks instead (``operators.scan.ranged_scan``).

Modes:
- ``partial``: what fits stays taken; a line that is short keeps its partial take.
- ``strict``: a line that does not fit whole takes nothing (the caller rolls back). Each line
  depends on the one before it, so a product's lines are served in order by one task, with a
  constant amount of memory (``_serve``), and its batches and lines are dealt a second time for the
  sweep. A product of more than ``LINES_PER_TASK`` rows is decided by all tasks in at most 64 rounds
  of prefix sums (``strict_accept``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import labels, rules
from shelfwise.functions.dates import AsOf
from shelfwise.operators.keys import new_keys
from shelfwise.operators.scan import large_keys, ranged_scan, windowed_scan, with_keys
from shelfwise.session import cut_lineage, rested

SUPPLY_ORDER = ["expiry_date", "received_date", "batch_id"]
DEMAND_ORDER = ["demand_date", "sale_id", "line_no", "supp_id", "sale_item_id"]
LINE_FIELDS = ["sale_item_id", "sale_id", "tag_item", "user_id"]
# Lines, or batches, of one product that one task serves (about a second's work); both ways decide alike.
LINES_PER_TASK = 1_000_000


@dataclass
class FefoResult:
    allocations: DataFrame
    movements: DataFrame
    batches: DataFrame
    shortfalls: DataFrame
    products: DataFrame | None
    decisions: DataFrame


def _candidates(batches: DataFrame, allocatable: Column) -> DataFrame:
    return (batches.where(allocatable & (F.col("quantity") > 0))
            .select("product_id", *SUPPLY_ORDER, F.col("quantity").cast("long").alias("s_qty")))


def _positions(cand: DataFrame, lines: DataFrame, order, by_day: bool) -> tuple[DataFrame, DataFrame]:
    """W-1: running supply per batch and, for each line, the supply that has expired by its day.

    Returns (product_id, batch_id, s_lo, s_hi) and the lines with ``q`` and ``floor``. Day by
    day, batches and lines are merged by (product, date), the batches of a date first: those
    have expired on it. At one as-of day nothing expires and the floor is 0.
    """
    lines = lines.withColumn("q", F.col("quantity").cast("long"))
    if not by_day:
        sup = ranged_scan(cand, ["product_id"], SUPPLY_ORDER, sums={"s_hi": F.col("s_qty")})
        return _supply(sup), lines.withColumn("floor", F.lit(0).cast("long"))
    s = cand.select("product_id", F.col("expiry_date").alias("_on"), F.lit(0).alias("_side"), "s_qty",
                    *[F.col(c).alias(f"_so{i}") for i, c in enumerate(SUPPLY_ORDER)], "batch_id")
    d = lines.select("product_id", F.col(order[0]).alias("_on"), F.lit(1).alias("_side"),
                     *[F.col(c).alias(f"_do{i}") for i, c in enumerate(order)],
                     F.struct(*lines.columns).alias("_line"))
    merged = ranged_scan(
        s.unionByName(d, allowMissingColumns=True), ["product_id"],
        ["_on", "_side", *[f"_so{i}" for i in range(len(SUPPLY_ORDER))], *[f"_do{i}" for i in range(len(order))]],
        sums={"s_hi": F.coalesce("s_qty", F.lit(0).cast("long"))})
    dem = merged.where(F.col("_side") == 1).select("_line.*", F.col("s_hi").alias("floor"))
    return _supply(merged.where(F.col("_side") == 0)), dem


def _supply(sup: DataFrame) -> DataFrame:
    return sup.select("product_id", "batch_id", "s_hi", (F.col("s_hi") - F.col("s_qty")).alias("s_lo"))


def _demand_intervals(lines: DataFrame, order, by_day: bool) -> DataFrame:
    """[d_lo, d_hi) per line: ``d_hi`` is the running demand plus the running maximum of how far
    a line's floor lies above the demand before it."""
    dem = ranged_scan(lines, ["product_id"], order, sums={"_sum": F.col("q")})
    if by_day:
        dem = ranged_scan(dem, ["product_id"], order,
                          maxes={"_skip": F.col("floor") - (F.col("_sum") - F.col("q"))})
        hi = F.col("_sum") + F.greatest(F.col("_skip"), F.lit(0))
    else:
        hi = F.col("_sum")
    return dem.select("product_id", *LINE_FIELDS, hi.alias("d_hi"), (hi - F.col("q")).alias("d_lo"))


def overlap_sweep(sup: DataFrame, dem: DataFrame) -> DataFrame:
    """J-9 without pairs: merge interval starts and carry the other side forward."""
    b_struct = F.struct("batch_id", "s_lo", "s_hi")
    d_struct = F.struct(*LINE_FIELDS, "d_lo", "d_hi")
    s_ev = sup.select("product_id", F.col("s_lo").alias("pos"), F.lit(0).alias("kind"),
                      F.col("batch_id").cast("string").alias("tb"),
                      b_struct.alias("b"), F.lit(None).cast(dem.select(d_struct).schema[0].dataType).alias("d"))
    d_ev = dem.select("product_id", F.col("d_lo").alias("pos"), F.lit(1).alias("kind"),
                      F.col("sale_item_id").cast("string").alias("tb"),
                      F.lit(None).cast(sup.select(b_struct).schema[0].dataType).alias("b"), d_struct.alias("d"))
    return _pairs(ranged_scan(s_ev.unionByName(d_ev), ["product_id"], ["pos", "kind", "tb"],
                              fills={"cb": "b", "cd": "d"}))


def _pairs(scanned: DataFrame) -> DataFrame:
    """The overlaps that start at the scanned events: ``b`` and ``d`` of the event itself, ``cb`` and ``cd`` carried."""
    b = F.when(F.col("kind") == 0, F.col("b")).otherwise(F.col("cb"))
    d = F.when(F.col("kind") == 1, F.col("d")).otherwise(F.col("cd"))
    pairs = scanned.select("product_id", b.alias("b"), d.alias("d")).where(
        F.col("b").isNotNull() & F.col("d").isNotNull())
    start = F.greatest("b.s_lo", "d.d_lo")
    taken = F.least("b.s_hi", "d.d_hi") - start
    # Both figures are at most one batch's quantity, an int.
    return (pairs.withColumn("taken", taken).withColumn("start_pos", start).where(F.col("taken") > 0)
            .select("product_id", *[f"d.{c}" for c in LINE_FIELDS], "b.batch_id",
                    F.col("taken").cast("int").alias("taken"),
                    (F.col("b.s_hi") - F.least("b.s_hi", "d.d_hi")).cast("int").alias("remaining_after"),
                    "start_pos"))


def strict_accept(lines: DataFrame, sup_total: DataFrame, order=DEMAND_ORDER, by_day: bool = False) -> DataFrame:
    """Decide which lines fit whole when lines are served one by one in ``order``.

    ``lines``: product_id, q, floor and the order's columns; a line fits when ``q`` is at most
    the units left, and the units left only shrink. Let ``p`` be the greatest power of two that
    is at most a product's units left. While at least ``p`` are left, every line under ``p``
    fits; a line of ``p`` or more that fits leaves less than ``p``. So in one round a product
    accepts its lines under ``p`` by a prefix sum, up to the first line that either finds less
    than ``p`` left (it waits for the next round) or is large and fits (it is accepted); the
    large lines before that one are refused. After a round a product is done or its units left
    have fewer binary digits: at most 64 rounds whatever the data, one checkpoint each.
    Returns (sale_item_id, accepted).
    """
    state = cut_lineage(lines.join(sup_total, "product_id", "left")
                        .withColumn("total", F.coalesce("s_total", F.lit(0).cast("long"))).drop("s_total")
                        .withColumn("at", F.lit(0).cast("long")))
    keep = state.columns
    here = F.struct(*order)
    decided = []
    while state.take(1):
        state = state.withColumn("p", F.expr("if(total > at, shiftleft(1L, length(bin(total - at)) - 1), 0L)"))
        small = F.col("q") < F.col("p")
        scanned = ranged_scan(state.withColumn("small", small), ["product_id"], order,
                              sums={"_sum": F.when(small, F.col("q")).otherwise(F.lit(0).cast("long"))})
        scanned = scanned.withColumn("_before", F.col("_sum") - F.when(F.col("small"), F.col("q"))
                                     .otherwise(F.lit(0).cast("long")))
        if by_day:
            scanned = ranged_scan(scanned, ["product_id"], order,
                                  maxes={"_skip": F.greatest("at", F.col("floor") - F.col("_before"))})
            before = F.col("_skip") + F.col("_before")
        else:
            before = F.col("at") + F.col("_before")
        left = F.col("total") - before
        waits = (F.col("p") > 0) & (left < F.col("p"))
        lands = ~F.col("small") & (F.col("p") > 0) & (F.col("q") <= left)
        scanned = scanned.withColumn("_waits", waits)
        first = (scanned.where(waits | lands).groupBy("product_id")
                 .agg(F.min(here).alias("_stop"),
                      F.min_by(F.struct(F.col("_waits").alias("waits"),
                                        (before + F.when(waits, F.lit(0)).otherwise(F.col("q"))).alias("next")),
                               here).alias("_ev")))
        j = scanned.join(first, "product_id", "left")
        is_stop = F.col("_stop").isNotNull() & (here == F.col("_stop"))
        later = F.col("_stop").isNotNull() & ((here > F.col("_stop")) | (is_stop & F.col("_ev.waits")))
        j = cut_lineage(j.withColumn("accepted", F.when(~later, F.col("small") | is_stop))
                        .withColumn("_next", F.col("_ev.next")))
        decided.append(j.where(F.col("accepted").isNotNull()).select("sale_item_id", "accepted"))
        state = j.where(F.col("accepted").isNull()).withColumn("at", F.col("_next")).select(*keep)
    out = decided[0] if decided else lines.sparkSession.createDataFrame(
        [], T.StructType([lines.schema["sale_item_id"], T.StructField("accepted", T.BooleanType())]))
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def serve_in_order(lines: DataFrame, sup_total: DataFrame, order=DEMAND_ORDER) -> DataFrame:
    """Serve each product's ``lines`` (as for ``strict_accept``) one by one in ``order``.

    The supply totals travel with the lines as rows that sort before them, so there is no join:
    one shuffle by product, a sort, and a pass that keeps a product's position and total only.
    Adds ``accepted`` and ``d_lo``, where an accepted line starts on the supply line (else NULL).
    """
    supply = (sup_total.where(F.col("product_id").isNotNull())
              .select("product_id", F.lit(True).alias("_supply"), F.col("s_total").alias("q")))
    rows = (supply.unionByName(lines.withColumn("_supply", F.lit(False)), allowMissingColumns=True)
            .repartition("product_id")
            .sortWithinPartitions("product_id", F.col("_supply").desc(), *order))

    return _serve(rows).where(~F.col("_supply")).drop("_supply")


def _serve(rows: DataFrame) -> DataFrame:
    """``rows`` lie by product, the units of its supply (``_supply``, ``q``) first, then its lines in order."""
    def serve(batches):
        import pyarrow as pa

        product, total, at = object(), 0, 0
        for batch in batches:
            accepted, start = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("product_id", "_supply", "q", "floor")]
            for key, is_supply, q, floor in zip(*columns):
                if key != product:
                    product, total, at = key, 0, 0
                if is_supply:
                    total += q
                    accepted.append(None)
                    start.append(None)
                    continue
                at = max(at, floor)
                fits = q <= total - at
                accepted.append(fits)
                start.append(at if fits else None)
                at += q if fits else 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(accepted, pa.bool_()), pa.array(start, pa.int64())],
                [*batch.schema.names, "accepted", "d_lo"])

    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType()),
                           T.StructField("d_lo", T.LongType())])
    return rows.mapInArrow(serve, schema)


def _by_product(cand: DataFrame, lines: DataFrame, mode: str, order, by_day: bool,
                own_tags: bool) -> tuple[DataFrame, DataFrame]:
    """The allocations of products that a task can serve alone, and the decision on every live line.

    Batches and lines are dealt by product once. Supply comes before the lines, day by day the batches of a
    date before its lines (they have expired on it), so one order gives the running supply, each
    line's floor and the running demand; the sweep then orders the same rows by position. With
    ``own_tags`` the lines are the items too (``_tags``): those that are not ``_live`` only tag others.
    """
    so, do = [f"_so{i}" for i in range(len(SUPPLY_ORDER))], [f"_do{i}" for i in range(len(order))]
    zero = F.lit(0).cast("long")
    s = cand.select("product_id", F.lit(True).alias("_supply"), F.col("s_qty").alias("q"), F.lit(True).alias("_live"),
                    *[F.col(c).alias(n) for c, n in zip(SUPPLY_ORDER, so)])
    fields = [c for c in LINE_FIELDS if c not in order]
    d = lines.select("product_id", F.lit(False).alias("_supply"), F.col("quantity").cast("long").alias("q"), "_live",
                     *[F.col(c).alias(n) for c, n in zip(order, do)], *[c for c in fields if not (own_tags and c == "tag_item")],
                     *(["line_no"] if own_tags and "line_no" not in order and "line_no" in lines.columns else []))
    rows = s.unionByName(d, allowMissingColumns=True).repartition("product_id")
    supply = F.col("_supply")
    merged = ([F.when(supply, F.col(so[0])).otherwise(F.col(do[0]))] if by_day else []) + [supply.desc(), *so, *do]
    sums = {"_hi": F.when(supply, F.col("q")).otherwise(zero)}
    if mode == "partial":
        sums["_sum"] = F.when(~supply & F.col("_live"), F.col("q")).otherwise(zero)
    rows = windowed_scan(rows, ["product_id"], merged, sums)
    rows = rows.withColumn("floor", F.col("_hi") if by_day else zero)
    at = {c: F.col(n) for c, n in zip(order, do)}
    item, sale = at.get("sale_item_id", F.col("sale_item_id")), at.get("sale_id", F.col("sale_id"))
    if mode == "partial":
        before = F.col("_sum") - F.col("q")
        if by_day:
            rows = windowed_scan(rows, ["product_id"], merged,
                                 maxes={"_skip": F.when(~supply & F.col("_live"), F.col("floor") - before)})
            before = before + F.greatest(F.col("_skip"), zero)
        rows = rows.withColumn("d_lo", F.when(~supply, before))
    if own_tags:
        numeric = isinstance(lines.schema["sale_item_id"].dataType, T.IntegralType)
        latest = item if numeric else F.struct(at.get("line_no", F.col("line_no")) if "line_no" in lines.columns
                                               else F.lit(None), item.alias("_item"))
        rows = (rows.withColumn("_sale", sale)
                .withColumn("_tag", F.max(F.when(~supply, latest)).over(Window.partitionBy("product_id", "_sale")))
                .withColumn("tag_item", F.when(sale.isNotNull() & F.col("product_id").isNotNull(),
                                               F.col("_tag") if numeric else F.col("_tag._item")))
                .drop("_sale", "_tag"))
    rows = rows.where("_live")
    if mode == "strict":
        rows = _serve(rows.sortWithinPartitions("product_id", supply.desc(), *do))
        decisions = rows.where(~supply).select(item.alias("sale_item_id"), "accepted")
        rows = rows.where(supply | F.col("accepted"))
    else:
        decisions = rows.where(~supply).select(item.alias("sale_item_id"), F.lit(True).alias("accepted"))
    given = {"sale_item_id": item, "sale_id": sale}
    line = [at.get(c, given.get(c, F.col(c))).alias(c) for c in LINE_FIELDS]
    events = rows.select(
        "product_id", F.when(supply, 0).otherwise(1).alias("kind"),
        F.when(supply, F.col("_hi") - F.col("q")).otherwise(F.col("d_lo")).alias("pos"),
        F.when(supply, F.col(so[-1]).cast("string")).otherwise(item.cast("string")).alias("tb"),
        F.when(supply, F.struct(F.col(so[-1]).alias("batch_id"), (F.col("_hi") - F.col("q")).alias("s_lo"),
                                F.col("_hi").alias("s_hi"))).alias("b"),
        F.when(~supply, F.struct(*line, (F.col("d_lo") + F.col("q")).alias("d_hi"), "d_lo")).alias("d"))
    return _pairs(windowed_scan(events, ["product_id"], ["pos", "kind", "tb"], fills={"cb": "b", "cd": "d"})), decisions


def _spread(cand: DataFrame, live: DataFrame, mode: str, order, by_day: bool) -> tuple[DataFrame, DataFrame]:
    """As ``_by_product`` for products of any size, each spread over all tasks."""
    sup, live = _positions(cand, live, order, by_day)
    if mode == "strict":
        live = cut_lineage(live)
        wanted = list(dict.fromkeys(["product_id", "sale_item_id", "q", "floor", *order]))
        totals = cand.groupBy("product_id").agg(F.sum("s_qty").alias("s_total"))
        decisions = strict_accept(live.select(*wanted), totals, order, by_day)
        live = live.join(decisions.where("accepted").select("sale_item_id"), "sale_item_id", "left_semi")
    else:
        decisions = live.select("sale_item_id", F.lit(True).alias("accepted"))
    return overlap_sweep(sup, _demand_intervals(live, order, by_day)), decisions


def _tags(items: DataFrame, demand: DataFrame | None = None) -> DataFrame:
    """W-3: the latest sale item of each (sale, product): the greatest key; of those in ``demand``, if it is given.

    Text keys end in their line's number, which does not sort as text, so the line leads.
    """
    if demand is not None:
        items = items.join(demand.select("sale_id", "product_id").distinct(), ["sale_id", "product_id"], "left_semi")
    numeric = isinstance(items.schema["sale_item_id"].dataType, T.IntegralType)
    latest = F.col("sale_item_id") if numeric else F.struct("line_no", "sale_item_id")
    return items.groupBy("sale_id", "product_id").agg(F.max_by("sale_item_id", latest).alias("tag_item"))


def _run(demand: DataFrame, batches: DataFrame, allocatable: Column, touched_asof: AsOf, instant: Column,
         mode: str, products: DataFrame | None, sale_items: DataFrame | None,
         ledger: DataFrame | None, order, by_day: bool) -> FefoResult:
    if mode not in ("partial", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    order = list(order)
    own_tags = sale_items is None or sale_items is demand
    if "user_id" not in demand.columns:
        demand = demand.withColumn("user_id", F.lit(None).cast("long"))
    served = F.col("quantity") > 0
    if own_tags and sale_items is not None:     # a line without a sale or product has no item
        served = served & F.col("sale_id").isNotNull() & F.col("product_id").isNotNull()
    if by_day:
        served = served & F.col(order[0]).isNotNull()
    lines = demand
    if not own_tags:
        lines = demand.join(_tags(sale_items), ["sale_id", "product_id"], "left")
        served = served & F.col("tag_item").isNotNull()
    lines = lines.withColumn("_live", F.coalesce(served, F.lit(False)))

    cand = _candidates(batches, allocatable)
    key = ["product_id"]
    hot = [h for h in (large_keys(demand, key, LINES_PER_TASK), large_keys(batches, key, LINES_PER_TASK)) if h is not None]
    if not hot:
        alloc, decisions = _by_product(cand, lines, mode, order, by_day, own_tags)
    else:
        large = hot[0] if len(hot) == 1 else hot[0].unionByName(hot[1]).distinct()
        alloc, decisions = _by_product(with_keys(cand, key, large, "left_anti"), with_keys(lines, key, large, "left_anti"),
                                       mode, order, by_day, own_tags)
        long = with_keys(lines, key, large, "left_semi")
        if own_tags:
            long = long.join(_tags(with_keys(demand, key, large, "left_semi")), ["sale_id", "product_id"], "left")
        needed = list(dict.fromkeys(["product_id", "quantity", *LINE_FIELDS, *order]))
        more, ruled = _spread(with_keys(cand, key, large, "left_semi"), long.where("_live").select(*needed),
                              mode, order, by_day)
        alloc, decisions = alloc.unionByName(more), decisions.unionByName(ruled)
    if by_day:
        alloc = alloc.join(demand.select("sale_item_id", F.col(order[0]).alias("day")), "sale_item_id")
    alloc = rested(alloc, "allocations")    # every result below reads it

    per_line = alloc.groupBy("sale_item_id").agg(F.sum("taken").cast("long").alias("allocated"))
    shortfalls = (demand.join(per_line, "sale_item_id", "left")
                  .select("sale_item_id", "sale_id", "product_id",
                          F.col("quantity").alias("requested"),
                          F.coalesce("allocated", F.lit(0).cast("long")).alias("allocated"))
                  .withColumn("short", F.greatest(F.col("requested") - F.col("allocated"), F.lit(0)))
                  .where(F.col("short") > 0))

    per_batch = alloc.groupBy("batch_id").agg(F.sum("taken").cast("int").alias("_taken"),
                                              F.max(instant).alias("_last"))
    touched = F.col("_taken").isNotNull()
    new_batches = (batches.join(per_batch, "batch_id", "left")
                   .withColumn("quantity", F.col("quantity") - F.coalesce("_taken", F.lit(0)))
                   .withColumn("status", F.when(touched, labels.batch_status(touched_asof)).otherwise(F.col("status")))
                   .withColumn("updated_at", F.coalesce("_last", "updated_at"))
                   .select(*batches.columns))

    # Within a batch, allocations start at increasing supply positions in demand order: keys in
    # that order (numbers that go on, or text with a zero-padded start) keep the ledger's
    # (date, id) order equal to it.
    text_key = F.concat_ws(":", F.col("batch_id").cast("string"), F.lit("sale"),
                           F.format_string("%019d", F.col("start_pos")))
    keyed = (new_keys(alloc, ledger, "movement_id", ["batch_id", "start_pos"], text_key)
             if ledger is not None else alloc.withColumn("movement_id", text_key))
    movements = keyed.select(
        "movement_id", "batch_id", F.col("tag_item").alias("sale_item_id"), F.lit("sale").alias("movement_type"),
        (-F.col("taken")).alias("quantity"), F.col("remaining_after").alias("remaining_quantity"),
        instant.alias("movement_date"), F.lit(None).cast("string").alias("notes"),
        F.col("user_id").alias("performed_by"))

    new_products = None
    if products is not None:
        sold = (demand.where(F.col("quantity") > 0)
                .join(shortfalls.select("sale_item_id"), "sale_item_id", "left_anti")
                .join(decisions.where("accepted").select("sale_item_id"), "sale_item_id", "left_semi")
                .groupBy("product_id").agg(F.sum("quantity").alias("_sold")))
        new_products = (products.join(sold, "product_id", "left")
                        .withColumn("current_stock", F.col("current_stock") - F.coalesce("_sold", F.lit(0).cast("long")))
                        .select(*products.columns))
    return FefoResult(alloc.drop("start_pos"), movements, new_batches, shortfalls, new_products, decisions)


def allocate(demand: DataFrame, batches: DataFrame, asof: AsOf, mode: str = "partial",
             products: DataFrame | None = None, sale_items: DataFrame | None = None,
             ledger: DataFrame | None = None, order=DEMAND_ORDER) -> FefoResult:
    """Allocate ``demand`` lines (sale-item shaped rows) to ``batches`` at ``asof``.

    Lines with quantity <= 0 take nothing. When ``sale_items`` is given, movements are
    tagged with the latest item of the line's (sale, product) from it and lines without
    one are rejected, as the reference's lookup ends the call; otherwise the demand rows
    themselves are the items. Movement keys go on after those of ``ledger`` if its keys are
    numbers; without a ledger they are text.
    """
    return _run(demand, batches, rules.stock_filter("allocatable", asof), asof, asof.t, mode, products,
                sale_items, ledger, order, by_day=False)


def allocate_by_day(demand: DataFrame, batches: DataFrame, mode: str = "partial", at: dt.time | None = None,
                    products: DataFrame | None = None, sale_items: DataFrame | None = None,
                    ledger: DataFrame | None = None, order=DEMAND_ORDER) -> FefoResult:
    """M-2 over many days: each line is served at the as-of of its own day, in ``order``, from
    what the lines before it left; batches expire in between. All days run as one job.

    The order's first column is the day; a line without a day takes nothing. ``at`` is the time
    of day used as "now" (default midnight). The allocations have the column ``day``.
    """
    instant = F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit((at or dt.time()).isoformat())))
    # Every real date is after this day, the first of the source's date type: which batches have
    # expired by a line's day is left to its floor, and one that a line touches has not expired.
    start = AsOf.of(dt.date(1000, 1, 1))
    return _run(demand, batches, rules.stock_filter("allocatable", start), start, instant, mode, products,
                sale_items, ledger, order, by_day=True)
