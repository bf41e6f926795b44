"""Stand-in request sets for the state-change jobs, derived from the driver tables.

Like ``derived``, these only shape rows into the request schemas; the jobs do the work.
Each has a twin in ``shelfwise.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.dates import AsOf
from shelfwise.sources.tables import Inventory


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receive_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of all lines, per flag/part/supplier/day.

    Lines shipped up to as_of are already batches (duplicates); later lines of
    the same day that differ in their flag collide with each other; products that one supplier ships on a day share
    a batch number; a part/supplier pair divisible by 11 asks for 0 units (invalid).
    """
    li = _read(spark, sf_dir, "lineitem")
    g = (li.groupBy("l_returnflag", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship"))
         .agg(F.sum("l_quantity").cast("int").alias("units"),
              F.min("l_extendedprice").cast("decimal(10,2)").alias("purchase_price")))
    sup = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    number = F.concat_ws("-", F.lit("LOT"), F.col("l_suppkey").cast("string"), F.date_format("ship", "yyyy-MM-dd"))
    return g.join(sup, "l_suppkey", "left").select(
        F.concat_ws(":", "l_returnflag", F.col("l_partkey").cast("string"), number).alias("request_id"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit(" "), number, F.lit(" ")).alias("batch_number"),
        F.when((F.col("l_partkey") + F.col("l_suppkey")) % 11 == 0, F.lit(0)).otherwise(F.col("units")).alias("quantity"),
        F.date_sub("ship", 30).alias("manufactured_date"),
        F.date_add("ship", 800).alias("expiry_date"),
        F.col("s_name").alias("supplier_name"),
        "purchase_price",
        F.col("l_suppkey").alias("user_id"),
    )


def dispose_requests(spark: SparkSession, sf_dir: str, inv: Inventory, asof: AsOf) -> DataFrame:
    """Write-offs for batches with at most 365 days left (empty ones included; an odd number
    of units that is divisible by 3 names a reason that is none), plus the ids of returns
    (flag R), which are not batches."""
    b = inv.batches.where(F.col("expiry_date") <= F.lit(asof.plus(rules.FRESH_MIN_DAYS))).select(
        F.concat(F.lit("D:"), F.col("batch_id")).alias("request_id"), "batch_id",
        F.when(F.col("quantity") % 2 == 0, F.lit("damage")).when(F.col("quantity") % 3 == 0, F.lit("lost")).alias("reason"),
        F.lit(None).cast("long").alias("user_id"))
    li = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    ghost = li.select(F.concat_ws("-", F.lit("RET"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                                  F.date_format(F.to_date("l_shipdate"), "yyyy-MM-dd")).alias("batch_id")).distinct()
    ghost = ghost.select(F.concat(F.lit("G:"), F.col("batch_id")).alias("request_id"), "batch_id",
                         F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("user_id"))
    return b.unionByName(ghost)


def adjust_requests(inv: Inventory) -> DataFrame:
    """Top-ups for every batch: one naming the batch, and one for its product only (no batch)."""
    named = inv.batches.select(F.concat(F.lit("A:"), F.col("batch_id")).alias("request_id"), "product_id", "batch_id",
                          ((F.col("original_quantity") % 9) + 1).alias("added_stock"),
                          F.lit(None).cast("long").alias("user_id"))
    plain = inv.batches.select(
        F.concat(F.lit("P:"), F.col("batch_id")).alias("request_id"), "product_id",
        F.lit(None).cast("string").alias("batch_id"), F.lit(5).alias("added_stock"),
        F.lit(None).cast("long").alias("user_id"))
    return named.unionByName(plain)


def new_product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new product per supplier row; a negative account balance is an invalid price."""
    s = _read(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("request_id"),
        F.concat(F.lit("  "), F.col("s_name"), F.lit(" kit ")).alias("product_name"),
        F.lit("Medical Supplies & Equipment").alias("category"),
        F.col("s_acctbal").cast("decimal(10,2)").alias("price"),
        F.lit(None).cast("date").alias("manufactured_date"),
        F.lit(None).cast("date").alias("expiry_date"),
        F.lit(None).cast("string").alias("how_to_use"),
        F.lit(None).cast("string").alias("side_effects"))


def update_product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rename and re-price of every part (brand prefixed, price plus size); other
    attributes are not sent, so they keep their values."""
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_name").alias("product_name"), F.col("p_type").alias("category"),
        (F.col("p_retailprice") + F.col("p_size")).cast("decimal(10,2)").alias("price"))


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete request for every part, and for every customer key shifted past the parts."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("request_id"),
                                             F.col("p_partkey").alias("product_id"))
    c = _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("request_id"),
        (F.col("c_custkey") + F.lit(1_000_000_000)).alias("product_id"))
    return p.unionByName(c)
