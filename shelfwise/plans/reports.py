"""Report jobs R-1 .. R-16 over an ``Inventory`` and an explicit ``AsOf``.

Every report is one lazy DataFrame plan. Product-level reports read the single
per-product batch aggregate (``operators.product_stock``); ORDER BY without LIMIT is
optional (``ordered=True``) because a global sort is pure cost for a table consumer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import dates, labels, rules
from shelfwise.functions.dates import AsOf
from shelfwise.operators.product_stock import batch_stats, products_with_stats
from shelfwise.sources.tables import Inventory


def _zero_nulled(col: str, flag: str):
    """A MIN where a zero date won: the date is NULL and the flag is set."""
    return F.when(F.col(flag), F.lit(None).cast("date")).otherwise(F.col(col))


def _only(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of the asked products (all without ``ids``), cut before any aggregate."""
    return df if ids is None else df.join(ids.select("product_id").distinct(), "product_id", "left_semi")


# --------------------------------------------------------------------------- R-1
def product_total_stock(inv: Inventory, asof: AsOf, ordered: bool = False) -> DataFrame:
    """R-1: products with unexpired batch stock, available batch count, nearest expiry."""
    df = products_with_stats(inv.products, inv.batches, asof).select(
        "product_id", "product_name", "category", "price",
        F.col("current_stock").alias("legacy_stock"),
        F.col("unexpired_stock").alias("batch_total_stock"),
        F.col("available_count").alias("active_batches"),
        _zero_nulled("available_min_expiry", "available_min_expiry_zero").alias("nearest_expiry"),
        F.col("available_min_expiry_zero").alias("nearest_expiry_zero"),
        "reorder_level", "reorder_quantity",
    )
    return df.orderBy("product_id") if ordered else df


# --------------------------------------------------------------------------- R-2
def expiring_batches(inv: Inventory, asof: AsOf, ordered: bool = False) -> DataFrame:
    """R-2: on-hand batches expiring within 90 days (or expired), with urgency."""
    b = inv.batches.where(rules.in_expiring_view(asof))
    p = inv.products.select("product_id", "product_name", "category")
    df = b.join(p, "product_id", "inner").select(
        "batch_id", "batch_number", "product_id", "product_name", "category", "quantity",
        "expiry_date", "expiry_date_zero", "supplier_name",
        dates.days_left("expiry_date", asof).alias("days_until_expiry"),
        labels.urgency(asof).alias("urgency_level"),
    )
    if ordered:
        df = df.orderBy(F.col("expiry_date_zero").desc(), F.col("expiry_date").asc(), "batch_id")
    return df


# --------------------------------------------------------------------------- R-3
def reorder_list(inv: Inventory, asof: AsOf, ordered: bool = False) -> DataFrame:
    """R-3: unexpired stock at or below the reorder level; needed may be 0 or negative."""
    df = (products_with_stats(inv.products, inv.batches, asof)
          .where(F.col("unexpired_stock") <= F.col("reorder_level"))
          .select("product_id", "product_name", "category",
                  F.col("unexpired_stock").alias("current_stock"),
                  "reorder_level", "reorder_quantity",
                  (F.col("reorder_quantity") - F.col("unexpired_stock")).alias("quantity_needed")))
    return df.orderBy("current_stock", "product_id") if ordered else df


# --------------------------------------------------------------------------- R-4
def available_stock(inv: Inventory, asof: AsOf, ids: DataFrame | None = None) -> DataFrame:
    """R-4 / D-1: allocatable stock per product id, 0 when none.

    ``ids`` (a one-column ``product_id`` DataFrame) asks for chosen ids, which need not
    exist; by default every product is listed.
    """
    keys = (inv.products if ids is None else ids).select("product_id")
    stats = batch_stats(_only(inv.batches, ids), asof).select("product_id", "allocatable_stock")
    return (keys.join(stats, "product_id", "left")
            .select("product_id", F.coalesce("allocatable_stock", F.lit(0).cast("long")).alias("available")))


# --------------------------------------------------------------------------- R-5, R-6
def inventory_kpis(inv: Inventory, asof: AsOf) -> DataFrame:
    """R-5 + R-6: the five dashboard counts and the overall status, in one pass.

    Batch-side counts include batches whose product is missing (the reference counts
    them from the batch table alone), hence the full outer join.
    """
    stats = batch_stats(inv.batches, asof).withColumn("_has_batches", F.lit(True))
    p = inv.products.select("product_id", "reorder_level").withColumn("_is_product", F.lit(True))
    j = p.join(stats, "product_id", "full_outer")
    fresh = F.coalesce(F.col("fresh_stock"), F.lit(0))
    is_product = F.coalesce(F.col("_is_product"), F.lit(False))
    row = j.agg(
        F.count(F.when(is_product & (fresh < F.col("reorder_level")), 1)).alias("needs_reorder"),
        F.count(F.when(is_product & (fresh == 0), 1)).alias("out_of_stock"),
        F.count(F.when(is_product & fresh.between(1, rules.GOOD_STOCK_ABOVE), 1)).alias("low_stock"),
        F.coalesce(F.sum("to_dispose_count"), F.lit(0)).cast("long").alias("to_dispose"),
        F.count(F.when(F.coalesce(F.col("has_expiring_soon"), F.lit(False)), 1)).alias("expiring_soon"),
    )
    status, colour = labels.overall_status(F.col("to_dispose"), F.col("out_of_stock"),
                                           F.col("expiring_soon"), F.col("low_stock"))
    return row.select("*", status.alias("inventory_status"), colour.alias("inventory_colour"))


# --------------------------------------------------------------------------- R-7, R-8
def repurchase_list(inv: Inventory, asof: AsOf, term: str | None = None,
                    ordered: bool = False) -> DataFrame:
    """R-7: fresh stock at or below the reorder level with units still needed."""
    products = rules.search(inv.products, term)
    df = (products_with_stats(products, inv.batches, asof)
          .withColumn("stocks_needed", F.col("reorder_quantity") - F.col("fresh_stock"))
          .where((F.col("fresh_stock") <= F.col("reorder_level")) & (F.col("stocks_needed") > 0))
          .select("product_id", "product_name", "category", "reorder_level", "reorder_quantity",
                  F.col("fresh_stock").alias("current_stock"), "stocks_needed",
                  labels.repurchase_colour(F.col("fresh_stock")).alias("colour")))
    return df.orderBy(F.col("stocks_needed").desc(), "product_id") if ordered else df


def repurchase_totals(inv: Inventory, asof: AsOf, term: str | None = None) -> DataFrame:
    """R-8: number of listed items and total units needed (0 when the list is empty)."""
    return repurchase_list(inv, asof, term).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(F.sum("stocks_needed"), F.lit(0)).cast("long").alias("total_units_needed"))


# --------------------------------------------------------------------------- R-9, R-10
def catalog(inv: Inventory, asof: AsOf, term: str | None = None, category: str | None = None,
            stock_level: str | None = None, expiry_status: str | None = None) -> DataFrame:
    """R-9: product listing with fresh stock, status (C-4), colour (C-8), badge (C-5).

    Search and category filter products before the join (pushed to the scan); the
    stock band and expiry status filter the joined rows. The two per-row lookups of the
    reference (earliest on-hand expiry, on-hand batch count) are columns of the same
    aggregate.
    """
    products = rules.by_category(rules.search(inv.products, term), category)
    df = products_with_stats(products, inv.batches, asof)
    df = rules.by_stock_level(df.withColumnRenamed("fresh_stock", "total_stock"), stock_level)
    nearest_zero = F.col("fresh_min_expiry_zero")
    status_date = F.when(nearest_zero, F.lit(None).cast("date")).otherwise(
        F.coalesce(F.col("fresh_min_expiry"), F.col("expiry_date")))
    own_zero = F.col("fresh_min_expiry").isNull() & F.col("expiry_date_zero")
    df = (df.withColumn("status_date", status_date)
            .withColumn("status_date_zero", nearest_zero | own_zero)
            .withColumn("status", labels.product_expiry_status(asof, "status_date")))
    df = rules.by_expiry_status(df, expiry_status)
    return df.select(
        "product_id", "product_name", "category", "current_stock", "price", "expiry_date",
        "manufactured_date", "how_to_use", "side_effects", "reorder_level", "total_stock",
        F.col("fresh_count").alias("batch_count"),
        _zero_nulled("fresh_min_expiry", "fresh_min_expiry_zero").alias("nearest_expiry"),
        "status",
        labels.stock_class(F.col("total_stock"), F.col("reorder_level")).alias("stock_class"),
        F.col("on_hand_count").alias("on_hand_batches"),
        labels.batch_badge(asof, "earliest_expiry").alias("badge"),
    )


def stock_listing(inv: Inventory, asof: AsOf, **filters) -> DataFrame:
    """R-10: the catalogue query plus the next-expiry display text and product code."""
    df = catalog(inv, asof, **filters)
    return (df.withColumn("next_expiry", labels.date_text(F.col("nearest_expiry")))
              .withColumn("product_code", labels.padded_id("PRD-", F.col("product_id"))))


# --------------------------------------------------------------------------- R-11, R-12
def batch_drilldown(inv: Inventory, asof: AsOf, ids: DataFrame | None = None) -> DataFrame:
    """R-11: every on-hand batch (of the products ``ids``, if given) with days left, card
    status (C-6) and the W-2 flag.

    W-2 "in use" is the batch with the fewest days left among those with at least 360
    days, first by batch id on ties: a per-product ``min(struct(expiry, batch_id))``
    (partially aggregated, so a hot product is no problem), joined back on the unique
    batch id rather than on the product.
    """
    b = _only(inv.batches.where(rules.on_hand()), ids)
    eligible = dates.at_or_after("expiry_date", asof.plus(rules.ACTIVE_MIN_DAYS))
    in_use = (b.where(eligible).groupBy("product_id")
              .agg(F.min(F.struct("expiry_date", "batch_id")).getField("batch_id").alias("batch_id"))
              .select("batch_id", F.lit(True).alias("in_use")))
    days = dates.days_left("expiry_date", asof)
    return (b.join(in_use, "batch_id", "left")
            .select("batch_id", "batch_number", "product_id", "quantity", "expiry_date",
                    "expiry_date_zero", "status", "manufactured_date", "supplier_name",
                    days.alias("days_left"),
                    F.coalesce("in_use", F.lit(False)).alias("in_use"),
                    labels.card_status(days, F.coalesce("in_use", F.lit(False)),
                                       dates.is_zero("expiry_date")).alias("card_status"),
                    (dates.is_zero("expiry_date") | (days < rules.ACTIVE_MIN_DAYS)).alias("disposable")))


def drilldown_totals(inv: Inventory, asof: AsOf, ids: DataFrame | None = None) -> DataFrame:
    """R-12: per product (of ``ids``, if given), active360 stock and batch count with the C-7 label."""
    df = products_with_stats(_only(inv.products.select("product_id"), ids), _only(inv.batches, ids), asof)
    return df.select("product_id",
                     F.col("active360_stock").alias("total_stock"),
                     F.col("active360_count").alias("active_count"),
                     labels.summary_label(F.col("active360_stock")).alias("label"))


# --------------------------------------------------------------------------- R-16, W-5
def batch_counts(inv: Inventory, ids: DataFrame | None = None) -> DataFrame:
    """R-16: number of batches per product (of ``ids``, if given; all statuses), 0 for none."""
    counts = _only(inv.batches, ids).groupBy("product_id").agg(F.count(F.lit(1)).alias("batch_count"))
    return (_only(inv.products.select("product_id"), ids).join(counts, "product_id", "left")
            .select("product_id", F.coalesce("batch_count", F.lit(0).cast("long")).alias("batch_count")))


# --------------------------------------------------------------------------- D-1
def register_sql_functions(inv: Inventory, asof: AsOf, view: str = "allocatable_batches") -> None:
    """D-1 for SQL users: ``available_stock(product_id)`` as a temporary SQL function.

    The stored function of the reference becomes a SQL function over a temp view of the
    batches that pass the stock rule; Catalyst decorrelates its scalar subquery into one aggregate and a join when
    it is called for many products.
    """
    spark = inv.batches.sparkSession
    inv.batches.where(rules.stock_filter("allocatable", asof)).createOrReplaceTempView(view)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION available_stock(pid BIGINT) RETURNS BIGINT
        RETURN (SELECT COALESCE(SUM(CAST(quantity AS BIGINT)), 0) FROM {view} WHERE product_id = pid)""")


# --------------------------------------------------------------------------- C-5
def batch_badges(inv: Inventory, asof: AsOf) -> DataFrame:
    """C-5 per product: earliest on-hand expiry, on-hand batch count and the badge."""
    df = products_with_stats(inv.products.select("product_id"), inv.batches, asof)
    return df.select("product_id",
                     _zero_nulled("earliest_expiry", "earliest_expiry_zero").alias("earliest_expiry"),
                     F.col("on_hand_count").alias("on_hand_batches"),
                     labels.batch_badge(asof, "earliest_expiry").alias("badge"))
