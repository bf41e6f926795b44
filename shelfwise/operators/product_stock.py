"""Per-product batch statistics: one aggregate below the products join (J-1, J-6).

The reference joins products to batches and then groups, once per page widget, and
runs two more per-row lookups for each listed product. Here every measure any report
needs is one column of a single ``groupBy(product_id)`` over batches. Spark's partial
aggregation combines map-side, so a product holding a third of all batches still
shuffles one row per map task; column pruning drops the measures a report does not
select. The result is one row per product, so the join to products is one-to-one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import dates, rules
from shelfwise.functions.dates import AsOf


def _qty():
    return F.col("quantity")


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, _qty()).otherwise(F.lit(0)).cast("long"))


def _count_if(cond: Column) -> Column:
    return F.count(F.when(F.coalesce(cond, F.lit(False)), F.lit(1)))


def batch_stats(batches: DataFrame, asof: AsOf) -> DataFrame:
    """One row per product_id with every batch measure used by the reports."""
    fresh = rules.stock_rule("fresh", asof)
    available = F.coalesce(F.col("status") == "available", F.lit(False))
    on_hand = _qty() > 0
    avail_min, avail_min_zero = dates.zero_aware_min("expiry_date", available)
    fresh_min, fresh_min_zero = dates.zero_aware_min("expiry_date", fresh)
    onhand_min, onhand_min_zero = dates.zero_aware_min("expiry_date", on_hand)
    return batches.groupBy("product_id").agg(
        _sum_if(fresh).alias("fresh_stock"),
        _sum_if(rules.stock_rule("unexpired", asof)).alias("unexpired_stock"),
        _sum_if(rules.stock_rule("allocatable", asof)).alias("allocatable_stock"),
        _sum_if(rules.stock_rule("active360", asof)).alias("active360_stock"),
        _count_if(rules.stock_rule("active360", asof)).alias("active360_count"),
        _sum_if(on_hand).alias("on_hand_stock"),
        _count_if(on_hand).alias("on_hand_count"),
        _count_if(available).alias("available_count"),
        avail_min.alias("available_min_expiry"),
        avail_min_zero.alias("available_min_expiry_zero"),
        _count_if(fresh).alias("fresh_count"),
        fresh_min.alias("fresh_min_expiry"),
        fresh_min_zero.alias("fresh_min_expiry_zero"),
        onhand_min.alias("earliest_expiry"),
        onhand_min_zero.alias("earliest_expiry_zero"),
        F.count(F.lit(1)).alias("batch_count_all"),
        _count_if(rules.to_dispose(asof)).alias("to_dispose_count"),
        (_count_if(rules.expiring_soon(asof)) > 0).alias("has_expiring_soon"),
    )


# Measures that are counts or sums: 0 for a product without batches.
ZERO_FILLED = ("fresh_stock", "unexpired_stock", "allocatable_stock", "active360_stock",
               "active360_count", "on_hand_stock", "on_hand_count", "available_count",
               "fresh_count", "batch_count_all", "to_dispose_count")
FALSE_FILLED = ("available_min_expiry_zero", "fresh_min_expiry_zero", "earliest_expiry_zero",
                "has_expiring_soon")


def products_with_stats(products: DataFrame, batches: DataFrame, asof: AsOf,
                        how: str = "left") -> DataFrame:
    """products ⟕ batch_stats on product_id, with counts and sums defaulting to 0."""
    stats = batch_stats(batches, asof)
    joined = products.join(stats, "product_id", how)
    fills = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ZERO_FILLED]
    fills += [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FALSE_FILLED]
    keep = [c for c in joined.columns if c not in ZERO_FILLED and c not in FALSE_FILLED]
    return joined.select(*keep, *fills)
