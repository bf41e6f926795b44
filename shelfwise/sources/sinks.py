"""Sinks: S-3 batch documents, S-4 report output. Stored tables (S-5) are in ``sources.state``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import dates
from shelfwise.functions.dates import AsOf
from shelfwise.operators.scan import running_count
from shelfwise.plans.reports import drilldown_totals
from shelfwise.sources.tables import Inventory

DOCUMENT_FIELDS = ("batch_id", "batch_number", "quantity", "expiry_date", "status", "manufactured_date",
                   "supplier_name")


def batch_documents(inv: Inventory, asof: AsOf, page_size: int = 500, as_json: bool = False) -> DataFrame:
    """S-3: per product, pages of its on-hand batches (expiry, then id; zero dates first)
    as sorted arrays, with the drill-down totals (R-12) on every page.

    A product's batches are split into pages of at most ``page_size`` so no single row or
    task collects an unbounded list, however many batches one product has.
    """
    b = (inv.batches.where(F.col("quantity") > 0)
         .withColumn("_nz", ~dates.is_zero("expiry_date")))
    ranked = running_count(b, ["product_id"], ["_nz", "expiry_date", "batch_id"], "_rank")
    paged = ranked.withColumn("page", ((F.col("_rank") - 1) / F.lit(page_size)).cast("long"))
    item = F.struct(F.col("_rank").alias("pos"), *[F.col(c) for c in DOCUMENT_FIELDS])
    docs = (paged.groupBy("product_id", "page")
            .agg(F.sort_array(F.collect_list(item)).alias("batches")))
    totals = drilldown_totals(inv, asof)
    out = docs.join(totals, "product_id", "left")
    if as_json:
        return out.select("product_id", "page", F.to_json(F.struct("batches", "total_stock", "active_count",
                                                                     "label")).alias("document"))
    return out


def flatten_documents(docs: DataFrame) -> DataFrame:
    """One row per batch of a document (for comparison with flat SQL)."""
    return (docs.select("product_id", "page", "total_stock", "active_count", "label",
                        F.explode("batches").alias("b"))
            .select("product_id", "page", "total_stock", "active_count", "label", "b.*"))


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """S-4: write a report as Parquet, CSV (with header) or JSON lines."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_ordered(df: DataFrame, path: str, order, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """S-4: write a report in a total order, over files of bounded size.

    ``order`` names columns, a leading ``-`` meaning descending numbers. Every row gets its ``position`` (from
    1) by the skew-safe scan, no file holds more than ``rows_per_file`` rows, and file names sort as
    the positions in them do, so the files read one after another are the report. Nothing is sorted in one task.
    """
    keys = {f"_o{i}": -F.col(c[1:]) if c.startswith("-") else F.col(c) for i, c in enumerate(order)}
    numbered = running_count(df.withColumns(keys), [], list(keys), "position").drop(*keys)
    placed = numbered.withColumn("_file", F.floor((F.col("position") - 1) / rows_per_file))
    # A range of positions per task; a file begins a task or follows the last full one of its task.
    writer = (placed.repartitionByRange("_file", "position").sortWithinPartitions("position").drop("_file")
              .write.option("maxRecordsPerFile", rows_per_file))
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
