"""State-change jobs M-1, M-3 .. M-9, applied to many requests at once.

The reference changes one row per HTTP request. Here each job takes the current
``Inventory`` and a DataFrame of requests and returns a ``JobResult``: the new table
state, the rows it added, and the rejected requests with a reason. Requests carry a
``request_id`` that orders them (the order the reference would have run them in).
Keys of added rows go on after the table's largest whole-number key, in request order
(``operators.keys``); tables with text keys get text that embeds what makes the row unique.
Every movement a run writes is dated ``asof.now``; within a run the ledger order is the
request order, and successive runs must use increasing
``now`` so that the ledger's (date, id) order is the order the runs happened in.
Nothing is written; ``sources.state`` persists a result: whole tables, or only what changed, for
which a result names the keys of the rows it changed and deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import labels, rules
from shelfwise.functions.dates import AsOf
from shelfwise.operators.keys import new_keys
from shelfwise.operators.scan import running_count, running_sum
from shelfwise.session import rested
from shelfwise.sources import schemas
from shelfwise.sources.tables import Inventory, conform


@dataclass
class JobResult:
    """New tables, added rows, rejects; ``changed`` and ``deleted`` hold, per table, the keys of the
    rows that were there before and now differ or are gone."""

    inventory: Inventory
    added: dict[str, DataFrame]
    rejects: DataFrame
    changed: dict[str, DataFrame] = field(default_factory=dict)
    deleted: dict[str, DataFrame] = field(default_factory=dict)


def _reject(df: DataFrame, reason: str) -> DataFrame:
    return df.select("request_id", F.lit(reason).alias("reject_reason"))


def _union_all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _with_optional(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add absent optional request columns as typed NULLs."""
    for name, dtype in cols.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def _first_per_key(req: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Split requests into the first per key (by request_id) and the later repeats.

    A grouped min is partially aggregated, so one key with many requests is cheap; the
    split joins back on the unique request id.
    """
    firsts = req.groupBy(*keys).agg(F.min("request_id").alias("request_id")).select("request_id")
    first = req.join(firsts, "request_id", "left_semi")
    later = req.join(firsts, "request_id", "left_anti")
    return first, later


def _first_where_dealt(req: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """``_first_per_key`` for requests that a join has just dealt by ``keys``: they are neither derived nor shuffled again."""
    least = F.min("request_id").over(Window.partitionBy(*keys))
    told = req.withColumn("_first", F.coalesce(F.col("request_id") == least, F.lit(False)))
    return told.where("_first").drop("_first"), told.where(~F.col("_first")).drop("_first")


# --------------------------------------------------------------------------- M-1
def receive(requests: DataFrame, inv: Inventory, asof: AsOf, once: bool = False) -> JobResult:
    """M-1: add batches (the add-batch procedure) after validation and duplicate checks.

    Requests: request_id, product_id, batch_number, quantity, manufactured_date,
    expiry_date, supplier_name, purchase_price, user_id. The new batch is ``available``
    whatever its size (the status trigger only runs on updates), received today, with a
    ``restock`` movement; legacy stock grows by the quantity. A batch number is unique
    within its product only: two products may share one. With ``once`` the accepted receipts are worked out
    here and rest in the shared folder, for a result of which several tables are written.
    """
    req = (requests.withColumn("batch_number", F.trim("batch_number"))
           .withColumn("supplier_name", F.trim("supplier_name")))
    ok, bad = rules.split_valid(req, {
        "invalid_product_id": F.col("product_id") > 0,
        "invalid_quantity": F.col("quantity") > 0,
        "empty_batch_number": rules.non_empty("batch_number"),
    })
    known = ok.join(inv.products.select("product_id"), "product_id", "left_semi")
    unknown = ok.join(inv.products.select("product_id"), "product_id", "left_anti")
    existing = inv.batches.select("product_id", "batch_number")
    dup = known.join(existing, ["product_id", "batch_number"], "left_semi")
    fresh_req = known.join(existing, ["product_id", "batch_number"], "left_anti")
    first, repeat = (_first_where_dealt if once else _first_per_key)(fresh_req, ["product_id", "batch_number"])
    first = new_keys(first, inv.batches, "batch_id", ["request_id"],
                     F.concat_ws(":", F.col("product_id").cast("string"), "batch_number"))
    first = new_keys(first, inv.movements, "movement_id", ["request_id"],
                     F.concat_ws(":", F.col("batch_id").cast("string"), F.lit("restock"),
                                 F.date_format(asof.t, "yyyyMMddHHmmss")))
    if once:
        first = rested(first, "receipts")

    new_batches = conform("product_batches", first.select(
        "batch_id", "product_id", "batch_number", "quantity",
        F.col("quantity").alias("original_quantity"), "manufactured_date", "expiry_date",
        "supplier_name", "purchase_price", asof.d.alias("received_date"),
        F.lit("available").alias("status"), asof.t.alias("created_at"), asof.t.alias("updated_at")))
    new_moves = conform("batch_movements", first.select(
        "movement_id", "batch_id", F.lit("restock").alias("movement_type"),
        "quantity", F.col("quantity").alias("remaining_quantity"), asof.t.alias("movement_date"),
        F.concat(F.lit("New batch added: "), F.col("batch_number")).alias("notes"),
        F.col("user_id").alias("performed_by")))
    added_units = first.groupBy("product_id").agg(F.sum("quantity").alias("_add"))
    products = (inv.products.join(added_units, "product_id", "left")
                .withColumn("current_stock", F.col("current_stock") + F.coalesce("_add", F.lit(0)))
                .withColumn("updated_at", F.when(F.col("_add").isNotNull(), asof.t).otherwise(F.col("updated_at")))
                .select(*inv.products.columns))
    rejects = _union_all([bad.select("request_id", "reject_reason"), _reject(unknown, "unknown_product"),
                          _reject(dup, "duplicate_batch"),
                          _reject(repeat, "duplicate_in_request")])
    out = inv.with_(batches=inv.batches.unionByName(new_batches),
                    movements=inv.movements.unionByName(new_moves), products=products)
    return JobResult(out, {"product_batches": new_batches, "batch_movements": new_moves}, rejects,
                     changed={"products": added_units.select("product_id")})


# --------------------------------------------------------------------------- W-5
def next_batch_numbers(requests: DataFrame, inv: Inventory) -> DataFrame:
    """W-5 + C-16: proposed batch numbers ``BTH-<product><nnn>`` for incoming rows.

    The sequence is the product's existing batch count plus the row's rank among the
    product's incoming rows (by request_id) — the count + 1 the form intends.
    """
    counts = inv.batches.groupBy("product_id").agg(F.count(F.lit(1)).alias("_have"))
    ranked = running_count(requests.select("request_id", "product_id"), ["product_id"], ["request_id"], "_rank")
    return (ranked.join(counts, "product_id", "left")
            .select("request_id", "product_id",
                    (F.coalesce("_have", F.lit(0)) + F.col("_rank")).alias("sequence"),
                    labels.batch_code(F.col("product_id"),
                                      F.coalesce("_have", F.lit(0)) + F.col("_rank")).alias("batch_number")))


# --------------------------------------------------------------------------- M-3
def dispose(requests: DataFrame, inv: Inventory, asof: AsOf, replay: bool = False) -> JobResult:
    """M-3: write off batches (reason ``expiry`` by default, or ``damage``).

    The batch keeps its row with quantity 0 and status ``depleted``; the ledger gets
    ``-quantity`` with remaining 0; legacy stock drops, clamped at 0. A batch that is
    already empty, or named again later in the same run, would only add a 0-unit row:
    that is skipped unless ``replay``. Any other reason is rejected.
    """
    req, odd = rules.split_valid(requests.withColumn("reason", F.coalesce(F.col("reason"), F.lit("expiry"))),
                                 {"invalid_reason": F.col("reason").isin(*schemas.DISPOSAL_REASONS)})
    b = inv.batches.select("batch_id", "product_id", "batch_number", F.col("quantity").alias("_qty"))
    b = b.join(inv.products.select("product_id"), "product_id", "left_semi")
    found = req.join(b, "batch_id", "inner")
    missing = req.join(b, "batch_id", "left_anti")
    first, later = _first_per_key(found, ["batch_id"])
    effective = first.withColumn("_units", F.col("_qty"))
    skipped = [later] if not replay else []
    if replay:
        effective = effective.unionByName(later.withColumn("_units", F.lit(0)))
    else:
        skipped.append(effective.where(F.col("_units") == 0))
        effective = effective.where(F.col("_units") > 0)
    keyed = new_keys(effective, inv.movements, "movement_id", ["request_id"],
                     F.concat_ws(":", F.col("batch_id").cast("string"), "reason", F.col("request_id").cast("string")))
    moves = conform("batch_movements", keyed.select(
        "movement_id", "batch_id", F.col("reason").alias("movement_type"), (-F.col("_units")).alias("quantity"),
        F.lit(0).alias("remaining_quantity"), asof.t.alias("movement_date"),
        F.concat(F.lit("Batch disposed: "), F.col("batch_number")).alias("notes"),
        F.col("user_id").alias("performed_by")))
    hit = effective.select("batch_id").distinct().withColumn("_hit", F.lit(True))
    batches = (inv.batches.join(hit, "batch_id", "left")
               .withColumn("quantity", F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("quantity")))
               .withColumn("status", F.when(F.col("_hit"), F.lit("depleted")).otherwise(F.col("status")))
               .withColumn("updated_at", F.when(F.col("_hit"), asof.t).otherwise(F.col("updated_at")))
               .select(*inv.batches.columns))
    per_product = effective.groupBy("product_id").agg(F.sum("_units").alias("_out"))
    products = (inv.products.join(per_product, "product_id", "left")
                .withColumn("current_stock", F.when(F.col("_out").isNull(), F.col("current_stock"))
                            .otherwise(labels.non_negative(F.col("current_stock") - F.col("_out"))))
                .select(*inv.products.columns))
    rejects = _union_all([odd.select("request_id", "reject_reason"), _reject(missing, "batch_not_found")]
                         + [_reject(s, "nothing_to_dispose") for s in skipped])
    out = inv.with_(batches=batches, movements=inv.movements.unionByName(moves), products=products)
    return JobResult(out, {"batch_movements": moves}, rejects,
                     changed={"product_batches": hit.select("batch_id"), "products": per_product.select("product_id")})


# --------------------------------------------------------------------------- M-4
def adjust(requests: DataFrame, inv: Inventory, asof: AsOf) -> JobResult:
    """M-4: add stock to products and, when a batch is named, to that batch.

    Legacy stock becomes the table's current value plus the added units (the client's
    stale "current" is not trusted). A named batch gets the units and a ``restock``
    movement whose remaining quantity is the running batch total over the run's requests.
    A request without units is rejected.
    """
    req, no_units = rules.split_valid(requests, {"invalid_units": F.col("added_stock").isNotNull()})
    known = req.join(inv.products.select("product_id"), "product_id", "left_semi")
    no_product = req.join(inv.products.select("product_id"), "product_id", "left_anti")
    named = known.where(F.col("batch_id").isNotNull())
    b = inv.batches.select("batch_id", F.col("quantity").alias("_old"))
    no_batch = named.join(b, "batch_id", "left_anti")
    valid = known.join(no_batch.select("request_id"), "request_id", "left_anti")
    to_batch = running_sum(valid.where(F.col("batch_id").isNotNull()).join(b, "batch_id", "inner"),
                           ["batch_id"], ["request_id"], "added_stock", "_run",
                           counted=requests.where(F.col("batch_id").isNotNull()))
    to_batch = new_keys(to_batch, inv.movements, "movement_id", ["request_id"],
                        F.concat_ws(":", F.col("batch_id").cast("string"), F.lit("restock"),
                                    F.col("request_id").cast("string")))
    moves = conform("batch_movements", to_batch.select(
        "movement_id", "batch_id", F.lit("restock").alias("movement_type"), F.col("added_stock").alias("quantity"),
        (F.col("_old") + F.col("_run")).alias("remaining_quantity"), asof.t.alias("movement_date"),
        F.lit("Stock updated via inventory management").alias("notes"), F.col("user_id").alias("performed_by")))
    per_batch = valid.where(F.col("batch_id").isNotNull()).groupBy("batch_id") \
        .agg(F.sum("added_stock").alias("_add"))
    batches = inv.batches.join(per_batch, "batch_id", "left")
    touched = F.col("_add").isNotNull()
    batches = (batches.withColumn("quantity", F.col("quantity") + F.coalesce("_add", F.lit(0)))
               .withColumn("status", F.when(touched, labels.batch_status(asof)).otherwise(F.col("status")))
               .withColumn("updated_at", F.when(touched, asof.t).otherwise(F.col("updated_at")))
               .select(*inv.batches.columns))
    per_product = valid.groupBy("product_id").agg(F.sum("added_stock").alias("_add"))
    products = (inv.products.join(per_product, "product_id", "left")
                .withColumn("current_stock", F.col("current_stock") + F.coalesce("_add", F.lit(0)))
                .select(*inv.products.columns))
    rejects = _union_all([no_units.select("request_id", "reject_reason"), _reject(no_product, "product_not_found"),
                          _reject(no_batch, "batch_not_found")])
    out = inv.with_(batches=batches, movements=inv.movements.unionByName(moves), products=products)
    return JobResult(out, {"batch_movements": moves}, rejects,
                     changed={"product_batches": per_batch.select("batch_id"), "products": per_product.select("product_id")})


# --------------------------------------------------------------------------- M-5
def reclassify(batches: DataFrame, asof: AsOf, only: DataFrame | None = None) -> DataFrame:
    """M-5: recompute status (C-3) for every batch, or only for the ``only`` batch ids.

    The reference's trigger runs on updated rows only, so time alone never turns a
    stored status into ``expired``; ``only`` reproduces that, the default ages all rows.
    """
    if only is None:
        return batches.withColumn("status", labels.batch_status(asof)).select(*batches.columns)
    hit = only.select("batch_id").distinct().withColumn("_hit", F.lit(True))
    return (batches.join(hit, "batch_id", "left")
            .withColumn("status", F.when(F.col("_hit"), labels.batch_status(asof)).otherwise(F.col("status")))
            .select(*batches.columns))


# --------------------------------------------------------------------------- M-6
def add_products(requests: DataFrame, inv: Inventory, asof: AsOf) -> JobResult:
    """M-6: insert products with stock 0 and default reorder settings.

    Ids continue after the largest existing id, in request order (a distributed row
    number, not ``monotonically_increasing_id``, so reruns give the same ids).
    """
    req = _with_optional(requests, {"manufactured_date": "date", "expiry_date": "date",
                                    "how_to_use": "string", "side_effects": "string"})
    req = (req.withColumn("product_name", F.trim("product_name"))
           .withColumn("category", F.trim("category")))
    ok, bad = rules.split_valid(req, {
        "empty_name": rules.non_empty("product_name"),
        "empty_category": rules.non_empty("category"),
        "invalid_price": F.col("price") > 0,
    })
    base = inv.products.agg(F.coalesce(F.max("product_id"), F.lit(0)).alias("m")).first()["m"]
    numbered = running_count(ok, [], ["request_id"], "_n")
    new = conform("products", numbered.select(
        (F.lit(base) + F.col("_n")).cast("long").alias("product_id"), "product_name", "category",
        "price", F.lit(0).alias("current_stock"), "manufactured_date", "expiry_date",
        F.trim("how_to_use").alias("how_to_use"), F.trim("side_effects").alias("side_effects"),
        asof.t.alias("created_at"), asof.t.alias("updated_at"),
        F.lit(schemas.DEFAULT_REORDER_LEVEL).alias("reorder_level"),
        F.lit(schemas.DEFAULT_REORDER_QUANTITY).alias("reorder_quantity")))
    out = inv.with_(products=inv.products.unionByName(new))
    return JobResult(out, {"products": new, "ids": numbered.select("request_id", (F.lit(base) + F.col("_n")).alias("product_id"))},
                     bad.select("request_id", "reject_reason"))


# --------------------------------------------------------------------------- M-7
UPDATABLE = ("product_name", "category", "price", "manufactured_date", "expiry_date",
             "how_to_use", "side_effects")


def update_products(requests: DataFrame, inv: Inventory, asof: AsOf) -> JobResult:
    """M-7: overwrite product attributes by id; the last request per id wins.

    The columns of ``UPDATABLE`` present in the requests are overwritten (the reference's
    form sends all of them). Legacy stock is kept (the reference's edit resets it to 0:
    not reproduced).
    """
    texts = ("product_name", "category", "how_to_use", "side_effects")
    req = requests.withColumns({c: F.trim(c) for c in texts if c in requests.columns})
    ok, bad = rules.split_valid(req, {
        "invalid_product_id": F.col("product_id") > 0,
        "empty_name": rules.non_empty("product_name"),
        "empty_category": rules.non_empty("category"),
        "invalid_price": F.col("price") > 0,
    })
    missing = ok.join(inv.products.select("product_id"), "product_id", "left_anti")
    fields = [c for c in UPDATABLE if c in requests.columns]
    last = (ok.groupBy("product_id")
            .agg(F.max_by(F.struct(*fields), F.col("request_id")).alias("_new")))
    j = inv.products.join(last, "product_id", "left")
    hit = F.col("_new").isNotNull()
    cols = []
    for c in inv.products.columns:
        if c in fields:
            cols.append(F.when(hit, F.col(f"_new.{c}").cast(inv.products.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c.endswith("_zero") and c.removesuffix("_zero") in fields:
            cols.append(F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c))   # the sent date replaces it
        elif c == "updated_at":
            cols.append(F.when(hit, asof.t).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    products = j.select(cols)
    rejects = _union_all([bad.select("request_id", "reject_reason"), _reject(missing, "not_found")])
    return JobResult(inv.with_(products=products), {}, rejects, changed={"products": last.select("product_id")})


# --------------------------------------------------------------------------- M-8
def delete_products(ids: DataFrame, inv: Inventory) -> JobResult:
    """M-8: delete products, cascading to their batches and those batches' movements.

    Refused when a sale item refers to the product (that key restricts); unknown ids, and
    later requests for a product that an earlier one deletes, are reported. ``ids``:
    request_id, product_id.
    """
    found = ids.join(inv.products.select("product_id"), "product_id", "left_semi")
    not_found = ids.join(inv.products.select("product_id"), "product_id", "left_anti")
    sold = inv.sale_items.select("product_id").distinct()  # combined map-side: a best seller is one row per task
    refused = found.join(sold, "product_id", "left_semi")
    first, later = _first_per_key(found.join(sold, "product_id", "left_anti"), ["product_id"])
    gone = first.select("product_id")
    products = inv.products.join(gone, "product_id", "left_anti")
    gone_batches = inv.batches.join(gone, "product_id", "left_semi").select("batch_id")
    batches = inv.batches.join(gone, "product_id", "left_anti")
    movements = inv.movements.join(gone_batches, "batch_id", "left_anti")
    gone_moves = inv.movements.join(gone_batches, "batch_id", "left_semi").select("movement_id")
    rejects = _union_all([_reject(not_found, "not_found"), _reject(later, "not_found"), _reject(refused, "has_sales")])
    return JobResult(inv.with_(products=products, batches=batches, movements=movements),
                     {"deleted_products": gone, "deleted_requests": first.select("request_id", "product_id"),
                      "deleted_batches": gone_batches}, rejects,
                     deleted={"products": gone, "product_batches": gone_batches, "batch_movements": gone_moves})


# --------------------------------------------------------------------------- M-9
def rebuild_legacy(inv: Inventory) -> DataFrame:
    """M-9: recompute legacy stock as the sum of batch quantities and show the drift."""
    per = inv.batches.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("_q"))
    return (inv.products.join(per, "product_id", "left")
            .select("product_id", F.col("current_stock").alias("legacy_stock"),
                    F.coalesce("_q", F.lit(0).cast("long")).alias("batch_stock"))
            .withColumn("difference", F.col("legacy_stock") - F.col("batch_stock")))
