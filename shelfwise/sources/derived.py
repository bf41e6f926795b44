"""Stand-in inventory tables built from the driver's TPC-H-style tables.

This only produces rows in the inventory schema (FIXTURES.md section 3); it does none of
a report's work. Every expression here has a twin in ``shelfwise.oracle`` so that the
DuckDB check sees the same six tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import labels
from shelfwise.functions.dates import AsOf
from shelfwise.sources.tables import Inventory, conform

# ---- fixed values of the stand-in mapping ---------------------------------------------
DRIVER_AS_OF = AsOf.of("1998-06-01", "1998-06-01 10:00:00")
PRODUCT_EXPIRY_BASE = dt.date(1997, 6, 1)
# ---------------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products_from(part: DataFrame, asof: AsOf) -> DataFrame:
    key = F.col("p_partkey")
    expiry = F.date_add(F.lit(PRODUCT_EXPIRY_BASE), ((key * 7) % 900).cast("int"))
    zero_expiry, zero_made = key % 50 == 7, key % 50 == 9
    return conform("products", part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        (F.col("p_size") * 7).cast("int").alias("current_stock"),
        F.when(~zero_made, F.date_sub(expiry, 730)).alias("manufactured_date"),
        F.when(~zero_expiry, expiry).alias("expiry_date"),
        zero_made.alias("manufactured_date_zero"),
        zero_expiry.alias("expiry_date_zero"),
        F.col("p_brand").alias("how_to_use"),
        F.col("p_name").alias("side_effects"),
        asof.t.alias("created_at"),
        asof.t.alias("updated_at"),
        (F.col("p_size") * 2).cast("int").alias("reorder_level"),
        (F.col("p_size") * 6).cast("int").alias("reorder_quantity"),
    ))


def batch_rows(lineitem: DataFrame, supplier: DataFrame, asof: AsOf) -> DataFrame:
    """Receipts: the lines shipped up to ``as_of``, one batch per part/supplier/day.

    Keeps ``supp_id`` next to the batch columns (the movement rows need it).
    """
    lines = (lineitem
             .where(F.col("l_shipdate") <= F.lit(asof.day).cast("timestamp_ntz"))
             .select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supp_id"),
                     F.to_date("l_shipdate").alias("received_date"), "l_quantity", "l_extendedprice"))
    grouped = (lines.groupBy("product_id", "supp_id", "received_date")
               .agg(F.sum("l_quantity").cast("int").alias("original_quantity"),
                    F.min("l_extendedprice").cast("decimal(10,2)").alias("purchase_price")))
    p, s = F.col("product_id"), F.col("supp_id")
    qty = (F.when((p + s) % 4 == 0, F.lit(0))
            .otherwise(F.floor(F.col("original_quantity") * ((p + 2 * s) % 10) / F.lit(10.0)))
            .cast("int"))
    shelf_days = (F.lit(730) + 90 * (p % 5) + 30 * (s % 6)).cast("int")
    day = F.date_format("received_date", "yyyy-MM-dd")
    key = F.concat_ws("-", F.lit("BTH"), p.cast("string"), s.cast("string"), day)
    number = F.concat_ws("-", F.lit("LOT"), s.cast("string"), day)   # unique within a product only
    names = supplier.select(F.col("s_suppkey").alias("supp_id"), F.col("s_name").alias("supplier_name"))
    # The names come before the derived columns, so that these texts and dates are not shuffled for them.
    out = (grouped.join(names, "supp_id", "left")
           .withColumn("quantity", qty)
           .withColumn("expiry_date", F.date_add("received_date", shelf_days))
           .withColumn("manufactured_date", F.date_sub("received_date", 30))
           .withColumn("expiry_date_zero", F.lit(False))
           .withColumn("manufactured_date_zero", F.lit(False))
           .withColumn("batch_number", number)
           .withColumn("batch_id", key)
           .withColumn("created_at", F.col("received_date").cast("timestamp"))
           .withColumn("updated_at", asof.t))
    return out.withColumn("status", labels.batch_status(asof))


def batches_from(lineitem: DataFrame, supplier: DataFrame, asof: AsOf) -> DataFrame:
    return conform("product_batches", batch_rows(lineitem, supplier, asof))


def movements_from(batches_with_supp: DataFrame) -> DataFrame:
    """A restock row per batch, plus one outgoing row when quantity differs from original."""
    b = batches_with_supp
    p, s = F.col("product_id"), F.col("supp_id")
    restock = b.select(
        F.concat_ws(":", "batch_id", F.lit("restock")).alias("movement_id"),
        "batch_id",
        F.lit("restock").alias("movement_type"),
        F.col("original_quantity").alias("quantity"),
        F.col("original_quantity").alias("remaining_quantity"),
        F.col("received_date").cast("timestamp").alias("movement_date"),
        F.concat(F.lit("New batch added: "), F.col("batch_number")).alias("notes"),
        s.alias("performed_by"),
    )
    kind = F.when((p + s) % 3 == 0, F.lit("expiry")).when((p + s) % 3 == 1, F.lit("damage")).otherwise(F.lit("sale"))
    outgoing = (b.where(F.col("quantity") != F.col("original_quantity"))
                .select(F.concat_ws(":", "batch_id", kind).alias("movement_id"),
                        "batch_id",
                        kind.alias("movement_type"),
                        (F.col("quantity") - F.col("original_quantity")).alias("quantity"),
                        F.col("quantity").alias("remaining_quantity"),
                        F.date_add("received_date", 30).cast("timestamp").alias("movement_date"),
                        F.lit(None).cast("string").alias("notes"),
                        F.lit(None).cast("long").alias("performed_by")))
    return conform("batch_movements", restock.unionByName(outgoing))


def sales_from(orders: DataFrame) -> DataFrame:
    return conform("sales", orders.select(
        F.col("o_orderkey").alias("sale_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
        F.when(F.col("o_orderstatus") == "F", F.lit("gcash")).otherwise(F.lit("cash")).alias("payment_method"),
        F.col("o_orderdate").cast("timestamp").alias("sale_date"),
    ))


def sale_items_from(lineitem: DataFrame) -> DataFrame:
    demand_date = F.to_date("l_shipdate")
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                      F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                      F.date_format(demand_date, "yyyy-MM-dd"))
    return conform("sale_items", lineitem.select(
        key.alias("sale_item_id"),
        F.col("l_orderkey").alias("sale_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(10,2)").alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("subtotal"),
        demand_date.alias("demand_date"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    ))


def users_from(customer: DataFrame) -> DataFrame:
    return conform("users", customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("admin")).otherwise(F.lit("staff")).alias("role"),
        F.lit("active").alias("status"),
    ))


def load_driver_inventory(spark: SparkSession, sf_dir: str, asof: AsOf = DRIVER_AS_OF) -> Inventory:
    """The six inventory tables derived from ``sf_dir`` (lazy DataFrames)."""
    batches = batch_rows(_read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "supplier"), asof)
    return Inventory(
        products=products_from(_read(spark, sf_dir, "part"), asof),
        batches=conform("product_batches", batches),
        movements=movements_from(batches),
        sales=sales_from(_read(spark, sf_dir, "orders")),
        sale_items=sale_items_from(_read(spark, sf_dir, "lineitem")),
        users=users_from(_read(spark, sf_dir, "customer")),
    )


def _twice(df: DataFrame, cond) -> DataFrame:
    return df.unionByName(df.where(cond))


def with_faults(inv: Inventory) -> Inventory:
    """The tables with planted faults of each kind the integrity checks look for."""
    def each(key: str, n: int):
        return F.col(key) % n == 0

    def unless(key: str, n: int, col: str):
        return F.when(F.coalesce(~each(key, n), F.lit(True)), F.col(col))

    def shifted(key: str, n: int, col: str):
        return F.when(each(key, n), F.col(col) + F.lit(1_000_000_000)).otherwise(F.col(col))

    def swapped(key: str, n: int, col: str, value):
        return F.when(each(key, n), value).otherwise(F.col(col))

    p, perf = "product_id", "performed_by"
    products = _twice(inv.products, each(p, 19)).withColumns({
        "product_name": unless(p, 7, "product_name"), "price": unless(p, 11, "price"),
        "category": F.when(each(p, 5), F.col("category")).otherwise(F.lit("Health & Personal Care")),
        "manufactured_date": swapped(p, 9, "manufactured_date", F.date_add("expiry_date", 1))})
    batches = _twice(inv.batches, each(p, 29)).withColumns({
        "status": swapped(p, 7, "status", F.lit("lost")), "received_date": unless(p, 11, "received_date"),
        "product_id": shifted(p, 13, "product_id"),
        "quantity": swapped(p, 17, "quantity", F.col("quantity") + 1),
        "manufactured_date": swapped(p, 31, "manufactured_date", F.date_add("expiry_date", 1)),
        "expiry_date": F.when((F.col(p) % 19 != 0) & (F.col(p) % 23 != 0), F.col("expiry_date")),
        "expiry_date_zero": each(p, 19)})
    movements = _twice(inv.movements, each(perf, 23)).withColumns({
        "movement_type": swapped(perf, 7, "movement_type", F.lit("gift")),
        "remaining_quantity": swapped(perf, 11, "remaining_quantity", F.col("remaining_quantity") + 1),
        "batch_id": swapped(perf, 13, "batch_id", F.concat(F.lit("none-"), F.col("batch_id"))),
        "quantity": unless(perf, 17, "quantity"),
        "sale_item_id": swapped(perf, 3, "sale_item_id", F.lit("none")),
        "performed_by": shifted(perf, 19, "performed_by")})
    sales = _twice(inv.sales, each("sale_id", 17)).withColumns({
        "payment_method": swapped("sale_id", 7, "payment_method", F.lit("card")),
        "total_amount": unless("sale_id", 11, "total_amount"), "user_id": shifted("sale_id", 13, "user_id")})
    items = _twice(inv.sale_items, each("sale_id", 19)).withColumns({
        "product_id": shifted("sale_id", 7, "product_id"), "subtotal": unless("sale_id", 13, "subtotal"),
        "unit_price": unless("sale_id", 17, "unit_price"), "sale_id": shifted("sale_id", 11, "sale_id")})
    users = _twice(inv.users, each("id", 19)).withColumns({
        "role": swapped("id", 7, "role", F.lit("guest")), "status": swapped("id", 11, "status", F.lit("gone")),
        "username": F.when(each("id", 17), F.lit("shared")).otherwise(unless("id", 13, "username"))})
    return Inventory(products, batches, movements, sales, items, users)


def materialize(spark: SparkSession, inv: Inventory, path: str) -> Inventory:
    """Write the six tables as Parquet under ``path`` (clustered like stored state) and
    read them back."""
    from shelfwise.sources.state import write_tables
    from shelfwise.sources.tables import load
    write_tables(inv, path)
    return load(spark, path)
