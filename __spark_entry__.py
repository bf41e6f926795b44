"""

Every query reads the driver tables under ``sf_dir``. Reports and jobs derive the six
inventory tables from them (``shelfwise.sources.derived``, plus request sets from
``shelfwise.sources.requests``) and run one report or job of the library at as-of
1998-06-01 10:00; the stream queries replay the events table (or the derived ledger)
through Structured Streaming. Decimal columns are returned as DOUBLE so that the DuckDB
oracle (which casts the same way) compares equal values.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

# The package sits next to this file; make it importable however this file is loaded.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from shelfwise.functions import rules
from shelfwise.functions.dates import AsOf
from shelfwise.oracle import ORACLE
from shelfwise.plans import checks, jobs, reports, sales
from shelfwise.plans.allocation import allocate_sales, allocate_sales_by_day
from shelfwise.session import rested, scratch_path
from shelfwise.sources import requests as req
from shelfwise.sources import sinks, state, tables
from shelfwise.sources.derived import DRIVER_AS_OF, load_driver_inventory, with_faults
from shelfwise.streaming import streams

# The training-data operators and their pipeline are an optional part: without their folder
# every other query still registers. Only their absence is tolerated, not errors inside them.
try:
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
    from corpus_pipeline import run as run_pipeline
    from shelfwise.llm.oracle import ORACLE as LLM_ORACLE
    from shelfwise.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    if missing.name not in {"corpus_pipeline", "shelfwise.llm", "shelfwise.llm.oracle", "shelfwise.llm.queries"}:
        raise
    LLM_QUERIES, LLM_ORACLE = {}, {}
else:
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": run_pipeline}
    LLM_ORACLE = {**LLM_ORACLE, **({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {})}

SMOKE_DIR = "/root/testdata/sf0.001"
ASOF = DRIVER_AS_OF
SEARCH_TERM = "blue"
CATEGORY = "PROMO"


def _normalize(df: DataFrame) -> DataFrame:
    cols = [F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(cols)


def _report(fn, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inv = load_driver_inventory(spark, sf_dir, ASOF)
        return _normalize(fn(inv, ASOF, **kwargs))
    run.__doc__ = fn.__doc__
    return run


def _no_asof(fn, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _normalize(fn(load_driver_inventory(spark, sf_dir, ASOF), **kwargs))
    run.__doc__ = fn.__doc__
    return run


def _fefo(part: str, mode: str = "partial") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        res = allocate_sales(load_driver_inventory(spark, sf_dir, ASOF), ASOF, mode)
        if part == "allocations":
            return _normalize(res.allocations)
        if part == "batches":
            return res.batches.select("batch_id", "product_id", "quantity", "status")
        return _normalize(res.shortfalls)
    run.__doc__ = f"M-2 FEFO allocation ({mode}): {part}."
    return run


def _fefo_by_day(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _normalize(allocate_sales_by_day(load_driver_inventory(spark, sf_dir, ASOF), mode).allocations)
    run.__doc__ = f"M-2 FEFO allocation ({mode}), each sale line at the as-of of its own day."
    return run


def _job(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _normalize(fn(spark, sf_dir, load_driver_inventory(spark, sf_dir, ASOF)))
    run.__doc__ = fn.__doc__
    return run


BATCH_COLS = ["batch_id", "product_id", "batch_number", "quantity", "original_quantity", "received_date",
              "expiry_date", "manufactured_date", "supplier_name", "status"]
MOVE_COLS = ["movement_id", "batch_id", "movement_type", "quantity", "remaining_quantity", "movement_date",
             "notes", "performed_by"]
PRODUCT_COLS = ["product_id", "product_name", "category", "price", "current_stock", "reorder_level",
                "reorder_quantity"]


def _receive(spark, sf_dir, inv):
    """M-1 receive: the new batch rows."""
    return jobs.receive(req.receive_requests(spark, sf_dir), inv, ASOF).added["product_batches"].select(BATCH_COLS)


def _receive_rejects(spark, sf_dir, inv):
    """M-1 receive: rejected requests with their reason."""
    return jobs.receive(req.receive_requests(spark, sf_dir), inv, ASOF).rejects


def _receive_stock(spark, sf_dir, inv):
    """M-1 receive: legacy stock of every product afterwards."""
    res = jobs.receive(req.receive_requests(spark, sf_dir), inv, ASOF)
    return res.inventory.products.select("product_id", "current_stock")


def _state_after_receipt(spark, sf_dir, inv):
    """S-5: the tables stored, the receipts brought in where they belong, and read back."""
    root = scratch_path(spark, "state")
    state.write_state(spark, inv, root, 1)
    res = jobs.receive(req.receive_requests(spark, sf_dir), state.read_state(spark, root), ASOF, once=True)
    state.write_changes(spark, root, res, 2)
    now = state.read_state(spark, root)
    return now.batches.select("batch_id", "product_id", "quantity", "status").join(
        now.products.select("product_id", "current_stock"), "product_id", "left")


def _next_numbers(spark, sf_dir, inv):
    """W-5 / C-16: proposed batch numbers for the receipt requests."""
    return jobs.next_batch_numbers(req.receive_requests(spark, sf_dir), inv)


def _dispose(spark, sf_dir, inv):
    """M-3 dispose: the new ledger rows."""
    return jobs.dispose(req.dispose_requests(spark, sf_dir, inv, ASOF), inv, ASOF).added["batch_movements"].select(MOVE_COLS)


def _dispose_rejects(spark, sf_dir, inv):
    """M-3 dispose: requests for unknown or empty batches."""
    return jobs.dispose(req.dispose_requests(spark, sf_dir, inv, ASOF), inv, ASOF).rejects


def _dispose_replay(spark, sf_dir, inv):
    """M-3 dispose with every request sent twice and replayed: the ledger rows, empty ones included."""
    once = req.dispose_requests(spark, sf_dir, inv, ASOF)
    twice = once.unionByName(once.withColumn("request_id", F.concat(F.lit("Z"), "request_id")))
    return jobs.dispose(twice, inv, ASOF, replay=True).added["batch_movements"].select(MOVE_COLS)


def _dispose_state(spark, sf_dir, inv):
    """M-3 dispose: batch quantity and status, and product legacy stock, afterwards."""
    res = jobs.dispose(req.dispose_requests(spark, sf_dir, inv, ASOF), inv, ASOF)
    return res.inventory.batches.select("batch_id", "product_id", "quantity", "status").join(
        res.inventory.products.select("product_id", "current_stock"), "product_id", "left")


def _adjust(spark, sf_dir, inv):
    """M-4 adjust: the new restock ledger rows."""
    return jobs.adjust(req.adjust_requests(inv), inv, ASOF).added["batch_movements"].select(MOVE_COLS)


def _adjust_state(spark, sf_dir, inv):
    """M-4 adjust: batch quantity/status and product legacy stock afterwards."""
    res = jobs.adjust(req.adjust_requests(inv), inv, ASOF)
    return res.inventory.batches.select("batch_id", "product_id", "quantity", "status").join(
        res.inventory.products.select("product_id", "current_stock"), "product_id", "left")


RECLASSIFY_ASOF = AsOf.of("1998-11-28", "1998-11-28 10:00:00")


def _reclassify(spark, sf_dir, inv):
    """M-5 reclassify every batch's status 180 days after the tables' as-of day."""
    return jobs.reclassify(inv.batches, RECLASSIFY_ASOF).select("batch_id", "quantity", "status")


def _reclassify_updated(spark, sf_dir, inv):
    """M-5 reclassify only the batches that disposal requests name."""
    named = req.dispose_requests(spark, sf_dir, inv, ASOF)
    return jobs.reclassify(inv.batches, RECLASSIFY_ASOF, only=named).select("batch_id", "quantity", "status")


def _add_products(spark, sf_dir, inv):
    """M-6 add products: the inserted rows with their new ids."""
    return jobs.add_products(req.new_product_requests(spark, sf_dir), inv, ASOF).added["products"].select(PRODUCT_COLS)


def _add_rejects(spark, sf_dir, inv):
    """M-6 add products: rejected requests."""
    return jobs.add_products(req.new_product_requests(spark, sf_dir), inv, ASOF).rejects


def _update_products(spark, sf_dir, inv):
    """M-7 update products: every product afterwards."""
    return jobs.update_products(req.update_product_requests(spark, sf_dir), inv, ASOF).inventory.products.select(PRODUCT_COLS)


def _delete_products(spark, sf_dir, inv):
    """M-8 delete products: outcome per request (deleted, has_sales, not_found)."""
    ids = req.delete_requests(spark, sf_dir)
    res = jobs.delete_products(ids, inv)
    deleted = res.added["deleted_requests"].withColumn("outcome", F.lit("deleted"))
    refused = ids.join(res.rejects, "request_id", "inner").withColumnRenamed("reject_reason", "outcome")
    return deleted.unionByName(refused)


def _delete_cascade(spark, sf_dir, inv):
    """M-8 delete products: rows left in products, batches and movements (one row each)."""
    out = jobs.delete_products(req.delete_requests(spark, sf_dir), inv).inventory
    parts = [df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
             for name, df in (("products", out.products), ("product_batches", out.batches),
                              ("batch_movements", out.movements))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _rebuild(spark, sf_dir, inv):
    """M-9 rebuild legacy stock from batch quantities."""
    return jobs.rebuild_legacy(inv)


def _check(fn, with_asof=False):
    def run(spark, sf_dir, inv):
        broken = with_faults(inv)
        return fn(broken, ASOF) if with_asof else fn(broken)
    run.__doc__ = f"On tables with planted faults. {fn.__doc__}"
    return run


def _ledger_by_parts(spark, sf_dir, inv):
    """I-5 / W-4 on tables with planted faults: the ledger up to 1995 is audited and its state stored, then the
    later rows are audited from that state, among them some that come late."""
    broken = with_faults(inv)
    # Derived once; both deliveries, the late rows and their batches are read from it.
    ledger = ["batch_id", "movement_date", "movement_id", "quantity", "remaining_quantity"]
    day, moves = F.col("movement_date"), rested(broken.movements.select(ledger), "ledger")
    # Outgoing rows of 1994 come with the second delivery, after later rows of their batches at times.
    early = F.coalesce((day < F.lit("1996-01-01")) & ~((F.year(day) == 1994) & (F.col("quantity") < 0)), F.lit(True))
    path = scratch_path(spark, "ledger-state")
    checks.ledger_state(moves.where(early)).write.parquet(path)
    state = checks.advance_ledger(spark.read.parquet(path), moves.where(~early), moves)
    return checks.check_ledger_state(state, broken.batches)


def _stream(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        if kind == "daily":
            return streams.stream_daily_sales(spark, events)
        if kind == "stock":
            return streams.stream_running_stock(spark, events)
        if kind == "ledger":
            return streams.stream_ledger_stock(spark, load_driver_inventory(spark, sf_dir, ASOF).movements)
        users = load_driver_inventory(spark, sf_dir, ASOF).users
        return streams.stream_activity(spark, events, users, n=10)
    source = "the derived stock ledger" if kind == "ledger" else "the events table"
    run.__doc__ = f"X stream ({kind}) replayed in time order from a landed copy of {source}."
    return run


def _stream_feed(spark, sf_dir, inv):
    """X-3 live feed: movements and sales replayed in time order as one stream."""
    return streams.stream_feed(spark, inv, ASOF, n=4)


def _documents(spark, sf_dir, inv):
    """S-3 batch documents (pages of 4 batches), flattened to one row per batch."""
    return sinks.flatten_documents(sinks.batch_documents(inv, ASOF, page_size=DOC_PAGE))


def _text_dates(spark, sf_dir, inv):
    """S-2: products whose expiry dates are stored as text, some zero and some malformed, read back apart."""
    key, day = F.col("product_id"), F.col("expiry_date")
    text = (F.when(F.col("expiry_date_zero"), F.lit("0000-00-00")).when(key % 11 == 0, F.date_format(day, "dd/MM/yyyy"))
            .when(key % 17 == 0, F.lit("1998-02-30")).when(key % 19 == 0, F.lit("")).otherwise(day.cast("string")))
    path = scratch_path(spark, "text-dates")
    inv.products.withColumn("expiry_date", text).drop("expiry_date_zero").write.parquet(path)
    clean, apart = tables.split_dates(spark.read.parquet(path), ["expiry_date"])
    return clean.select("product_id", "expiry_date", "expiry_date_zero", F.lit(None).cast("string").alias("reject_reason")) \
        .unionByName(apart.select("product_id", F.lit(None).cast("date").alias("expiry_date"),
                                  F.lit(False).alias("expiry_date_zero"), "reject_reason"))


def _search_accents(spark, sf_dir, inv):
    """F-1, F-2: products whose names and categories carry accents, found blind to them, with a wildcard."""
    marked = {c: F.when(F.col("product_id") % 2 == 0, F.translate(c, "aeiouAEIOU", "áéïôùÂÈÍÖÛ")).otherwise(F.col(c))
              for c in ("product_name", "category")}
    found = rules.by_category(rules.search(inv.products.withColumns(marked), "BL_É"), "prömo")
    return found.select("product_id", "product_name", "category")


def _report_files(spark, sf_dir, inv):
    """S-4: the repurchase list written in its order over files of 100 rows, and read back."""
    path = scratch_path(spark, "report")
    sinks.write_ordered(reports.repurchase_list(inv, ASOF), path, ["-stocks_needed", "product_id"], rows_per_file=100)
    return spark.read.parquet(path).select("position", "product_id", "stocks_needed")


def _stock_by_sql(spark, sf_dir, inv):
    """D-1: the stored function as a SQL function, called for every product."""
    reports.register_sql_functions(inv, ASOF)
    inv.products.createOrReplaceTempView("listed_products")
    return spark.sql("SELECT product_id, available_stock(product_id) AS available FROM listed_products")


DOC_PAGE = 4


def _registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "product_total_stock": _report(reports.product_total_stock),
        "expiring_batches": _report(reports.expiring_batches),
        "reorder_list": _report(reports.reorder_list),
        "available_stock": _report(reports.available_stock),
        "inventory_kpis": _report(reports.inventory_kpis),
        "repurchase_list": _report(reports.repurchase_list),
        "repurchase_search": _report(reports.repurchase_list, term=SEARCH_TERM),
        "repurchase_ordered": _report(reports.repurchase_list, ordered=True),
        "reorder_ordered": _report(reports.reorder_list, ordered=True),
        "expiring_ordered": _report(reports.expiring_batches, ordered=True),
        "repurchase_totals": _report(reports.repurchase_totals),
        "catalog_all": _report(reports.catalog),
        "catalog_search": _report(reports.catalog, term=SEARCH_TERM),
        "catalog_category": _report(reports.catalog, category=CATEGORY),
        "catalog_good": _report(reports.catalog, stock_level="good"),
        "catalog_low": _report(reports.catalog, stock_level="low"),
        "catalog_out": _report(reports.catalog, stock_level="out"),
        "catalog_expiring": _report(reports.catalog, expiry_status="expiring"),
        "catalog_expired": _report(reports.catalog, expiry_status="expired"),
        "stock_listing": _report(reports.stock_listing),
        "batch_badges": _report(reports.batch_badges),
        "batch_drilldown": _report(reports.batch_drilldown),
        "drilldown_totals": _report(reports.drilldown_totals),
        "batch_counts": _no_asof(reports.batch_counts),
        "sales_today": _report(sales.sales_today),
        "sales_history": _report(sales.sales_history),
        "sales_by_daypart": _report(sales.sales_by_daypart),
        "activity_feed": _report(sales.activity_feed, n=4),
        "fefo_allocations": _fefo("allocations"),
        "fefo_batches_after": _fefo("batches"),
        "fefo_shortfalls": _fefo("shortfalls"),
        "fefo_strict": _fefo("allocations", mode="strict"),
        "fefo_by_day": _fefo_by_day("partial"),
        "fefo_by_day_strict": _fefo_by_day("strict"),
        "receive_batches": _job(_receive),
        "receive_rejects": _job(_receive_rejects),
        "receive_stock": _job(_receive_stock),
        "state_after_receipt": _job(_state_after_receipt),
        "next_batch_number": _job(_next_numbers),
        "dispose_batches": _job(_dispose),
        "dispose_rejects": _job(_dispose_rejects),
        "dispose_state": _job(_dispose_state),
        "dispose_replay": _job(_dispose_replay),
        "adjust_stock": _job(_adjust),
        "adjust_state": _job(_adjust_state),
        "reclassify_status": _job(_reclassify),
        "reclassify_updated": _job(_reclassify_updated),
        "add_products": _job(_add_products),
        "add_product_rejects": _job(_add_rejects),
        "update_products": _job(_update_products),
        "delete_products": _job(_delete_products),
        "delete_cascade": _job(_delete_cascade),
        "rebuild_legacy": _job(_rebuild),
        "check_unique": _job(_check(checks.check_unique)),
        "check_foreign_keys": _job(_check(checks.check_foreign_keys)),
        "check_domains": _job(_check(checks.check_domains)),
        "check_nulls": _job(_check(checks.check_nulls)),
        "check_ledger": _job(_check(checks.check_ledger)),
        "check_ledger_by_parts": _job(_ledger_by_parts),
        "check_status": _job(_check(checks.check_status, with_asof=True)),
        "check_dates": _job(_check(checks.check_dates)),
        "batch_documents": _job(_documents),
        "search_accents": _job(_search_accents),
        "text_dates": _job(_text_dates),
        "report_files": _job(_report_files),
        "available_stock_sql": _job(_stock_by_sql),
        "stream_daily_sales": _stream("daily"),
        "stream_batch_stock": _stream("stock"),
        "stream_activity": _stream("activity"),
        "stream_ledger_stock": _stream("ledger"),
        "stream_feed": _job(_stream_feed),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query (R-1 product total stock) on the sf0.001 tables."""
    return queries()["product_total_stock"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_registry(), **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    names = set(queries())
    return {k: v for k, v in {**ORACLE, **LLM_ORACLE}.items() if k in names}
