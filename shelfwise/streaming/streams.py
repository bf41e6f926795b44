"""Structured Streaming versions of the live dashboard (X-1 .. X-3).

The reference reloads its dashboard every 60 seconds; here the same figures are kept
current by streaming queries over an append-only event feed:

- X-1 ``daily_sales``: watermarked event-time windows of one day, sum and count.
- X-2 ``running_stock``: a running total per key (``+1``/``-1`` deltas), update mode.
- X-3 ``run_feed``: movements, and sales joined with their items as a stream-stream join, so a sale
  shows once an item of it has come, whichever is delivered first; ``foreachBatch`` joins each
  micro-batch with batches, products and users and keeps the newest n. ``activity`` does so for
  plain events and users.

X-1, X-2 and ``activity`` de-duplicate repeated deliveries by event id within the watermark; the
feed and the ledger balance do so by key, however late a row comes (the feed's join may be given a
time after which it forgets). The ledger balance is read from the query's own state, one row a
batch (``ledger_balance``). Other results
go to Parquet folders under the shared checkpoint folder through ``foreachBatch``: update
mode writes the changed rows of each micro-batch tagged with the batch id, and
``latest`` resolves the current value per key (newest batch wins). Tests and the
registry replay a table into a landing folder one event-time slice at a time, running
the query with ``availableNow`` after each slice on one checkpoint (offsets and the
watermark carry over); production would use ``processingTime='60 seconds'`` on the same
plan.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.dates import AsOf
from shelfwise.plans import sales
from shelfwise.session import scratch_path
from shelfwise.sources.tables import Inventory

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# ---- fixed values of the event mapping (FIXTURES section 4) ---------------------------
SALE_EVENT = "purchase"
STOCK_DELTAS = {"purchase": -1, "signup": 1}
FEED_EVENTS = ("purchase", "error")
# -----------------------------------------------------------------------------------------


def typed_events(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields])


def time_slices(df: DataFrame, ts_col: str, parts: int) -> list:
    """Conditions cutting ``df`` into ``parts`` consecutive event-time slices."""
    bounds = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    if bounds["lo"] is None:
        return [F.lit(True)]
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) / parts
    conds = []
    for i in range(parts):
        cond = F.col(ts_col) >= F.lit(lo + step * i)
        if i < parts - 1:
            cond = cond & (F.col(ts_col) < F.lit(lo + step * (i + 1)))
        else:
            cond = cond | F.col(ts_col).isNull()
        conds.append(cond)
    return conds


def replay_in_order(df: DataFrame, ts_col: str, landing: str, parts: int, run) -> None:
    """Deliver ``df`` to a landing folder one event-time slice at a time, running the
    streaming query to completion (``availableNow``) after each slice.

    The query keeps one checkpoint, so offsets and the watermark carry over between runs
    and each run reads only the newly landed slice: the feed arrives in time order
    without relying on file modification times.
    """
    for cond in time_slices(df, ts_col, parts):
        df.where(cond).write.mode("append").parquet(landing)
        run()


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def daily_sales(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """X-1: sales per calendar day (UTC) from purchase events."""
    bought = (events.where(F.col("event_type") == SALE_EVENT)
              .withWatermark("ts", watermark)
              .dropDuplicatesWithinWatermark(["event_id"]))
    return (bought.groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.sum("value").alias("total_sales"), F.count(F.lit(1)).alias("sales_count"))
            .select(F.to_date(F.col("w.start")).alias("day"), "total_sales", "sales_count"))


def running_stock(events: DataFrame, key: str = "user_id", watermark: str = "1 hour") -> DataFrame:
    """X-2: running total of +1/-1 deltas per key (update mode)."""
    delta = F.lit(None).cast("long")
    for kind, d in STOCK_DELTAS.items():
        delta = F.when(F.col("event_type") == kind, F.lit(d)).otherwise(delta)
    moves = (events.where(F.col("event_type").isin(*STOCK_DELTAS))
             .withWatermark("ts", watermark)
             .dropDuplicatesWithinWatermark(["event_id"])
             .withColumn("delta", delta))
    return moves.groupBy(key).agg(F.sum("delta").alias("stock"), F.count(F.lit(1)).alias("moves"))


def activity(events: DataFrame, users: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """X-3 input: feed events joined (stream-static) with the users table."""
    feed = (events.where(F.col("event_type").isin(*FEED_EVENTS))
            .withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["event_id"]))
    u = users.select(F.col("id").alias("user_id"), "username")
    return feed.join(u, "user_id", "inner").select("event_id", "ts", "user_id", "event_type", "value", "username")


# State that grows with the ledger rests on disk; all stores of an executor share one bound of memory (500 MB).
# The default keeps every key of every partition on the executor's heap, two versions of it.
HEAP_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
# Both sides of a join rest in one store a partition, not in four that each take memory of their own.
JOIN_CONF = {"spark.sql.streaming.join.stateFormatVersion": "3"}


def _start(stream: DataFrame, writer, trigger: str | None):
    """``trigger=None`` drains what is available and waits (tests, replays); a duration
    such as ``"60 seconds"`` starts a continuous query and returns it (the dashboard).

    A query keeps the settings that the session has as it starts; they are put back then. Settings of the
    submitter other than Spark's default stay."""
    conf = stream.sparkSession.conf
    kept = {k: conf.get(k, None) for k in (*STATE_CONF, *JOIN_CONF)}
    for k, v in STATE_CONF.items():
        if kept[k] is None or kept[k] == HEAP_STATE:
            conf.set(k, v)
    if "RocksDB" in conf.get("spark.sql.streaming.stateStore.providerClass"):
        for k, v in JOIN_CONF.items():
            conf.set(k, v)
    try:
        if trigger is not None:
            return writer.trigger(processingTime=trigger).start()
        q = writer.trigger(availableNow=True).start()
    finally:
        for k, v in kept.items():
            conf.unset(k) if v is None else conf.set(k, v)
    q.awaitTermination()
    return q


def run_update(stream: DataFrame, out: str, checkpoint: str, trigger: str | None = None):
    """Run an aggregation in update mode; each batch's changed rows are appended under
    ``out`` with their batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch replayed after a failure replaces its own partition (idempotent).
        (batch.withColumn("_batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(out))

    return _start(stream, stream.writeStream.outputMode("update").foreachBatch(write)
                  .option("checkpointLocation", checkpoint), trigger)


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # an output folder that no batch has written yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def latest(spark: SparkSession, out: str, keys, schema: T.StructType) -> DataFrame:
    """Current value per key of an update-mode output folder (newest batch wins)."""
    df = _read_or_none(spark, out)
    if df is None:
        return spark.createDataFrame([], schema)
    values = [c for c in df.columns if c not in keys and c != "_batch"]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("_batch")).alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]))


def run_top_n(stream: DataFrame, out: str, checkpoint: str, n: int, order, trigger: str | None = None):
    """X-3 sink: after each micro-batch keep the newest ``n`` rows seen so far.

    Each batch appends a new version (``_version`` = batch id) built from the previous
    version plus the batch, so only n + batch rows are handled and nothing is rewritten
    in place; a batch replayed after a failure rewrites the same version number.
    ``newest_version`` reads the current top n.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = newest_version(spark, out, before=batch_id)
        merged = batch if prev is None else prev.unionByName(batch)
        (merged.orderBy(*order).limit(n).withColumn("_version", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_version").parquet(out))

    return _start(stream, stream.writeStream.outputMode("append").foreachBatch(write)
                  .option("checkpointLocation", checkpoint), trigger)


def newest_version(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The newest complete top-n version (optionally the newest before a batch id)."""
    df = _read_or_none(spark, out)
    if df is None:
        return None
    if before is not None:
        df = df.where(F.col("_version") < before)
    top = df.agg(F.max("_version").alias("v")).first()["v"]
    if top is None:
        return None
    return df.where(F.col("_version") == top).drop("_version")


def replay_paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """(landing, output, checkpoint) paths for a replay under the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/landing", f"{base}/out", f"{base}/checkpoint"


# ---- end-to-end runs over a landed copy of an event table ----------------------------
DAILY_SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("total_sales", T.DoubleType()),
                             T.StructField("sales_count", T.LongType())])
STOCK_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("stock", T.LongType()),
                             T.StructField("moves", T.LongType())])


def feed_order():
    return (F.col("ts").desc(), F.col("event_id").desc())


def stream_daily_sales(spark: SparkSession, events: DataFrame, watermark: str = "1 hour",
                       parts: int = 4) -> DataFrame:
    landing, out, ckpt = replay_paths(spark, "daily-sales")
    replay_in_order(typed_events(events), "ts", landing, parts,
                    lambda: run_update(daily_sales(read_events(spark, landing), watermark), out, ckpt))
    return latest(spark, out, ["day"], DAILY_SCHEMA)


def stream_running_stock(spark: SparkSession, events: DataFrame, watermark: str = "1 hour",
                         parts: int = 4) -> DataFrame:
    landing, out, ckpt = replay_paths(spark, "running-stock")
    replay_in_order(typed_events(events), "ts", landing, parts,
                    lambda: run_update(running_stock(read_events(spark, landing), "user_id", watermark), out, ckpt))
    return latest(spark, out, ["user_id"], STOCK_SCHEMA)


def stream_activity(spark: SparkSession, events: DataFrame, users: DataFrame, n: int = 10,
                    watermark: str = "1 hour", parts: int = 4) -> DataFrame:
    landing, out, ckpt = replay_paths(spark, "activity")
    replay_in_order(typed_events(events), "ts", landing, parts,
                    lambda: run_top_n(activity(read_events(spark, landing), users, watermark), out, ckpt, n,
                                      feed_order()))
    top = newest_version(spark, out)
    if top is None:
        return spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, "
                                         "value double, username string")
    return top.select("event_id", "ts", "user_id", "event_type", "value", "username")


# ---- X-3 over the ledger and the sales -------------------------------------------------
FEED_KEY = ["activity_type", "movement_id", "sale_id"]


def sold_items(sold: DataFrame, items: DataFrame, keep: str | None = None) -> DataFrame:
    """The stream of (sale, item) pairs of a stream of sales and one of sale items.

    Both sides wait in the state store for the other, so a sale may come before or after its items,
    and each item of a sale gives one row. Repeated deliveries count once. Without ``keep`` nothing
    is forgotten. With it (an interval such as ``"3 days"``) an item belongs to its sale only if their times
    lie at most that far apart, rows later than that behind the newest one are dropped, and state
    that can meet no row any more goes.
    """
    s = sold.select("sale_id", "user_id", "total_amount", "payment_method", F.col("sale_date").alias("movement_date"))
    i = items.select(F.col("sale_id").alias("_sale"), "sale_item_id", F.col("created_at").alias("_at"))
    if keep is None:
        s, i, near = s.dropDuplicates(["sale_id"]), i.dropDuplicates(["sale_item_id"]), F.lit(True)
    else:
        s = s.withWatermark("movement_date", keep).dropDuplicatesWithinWatermark(["sale_id"])
        i = i.withWatermark("_at", keep).dropDuplicatesWithinWatermark(["sale_item_id"])
        span = F.expr(f"interval {keep}")
        near = F.col("_at").between(F.col("movement_date") - span, F.col("movement_date") + span)
    return (s.join(i, (F.col("sale_id") == F.col("_sale")) & near)
            .select(F.lit("sale").alias("activity_type"), *s.columns, "sale_item_id"))


def feed_stream(moves: DataFrame, sold: DataFrame, items: DataFrame, keep: str | None = None) -> DataFrame:
    """Movements and (sale, item) pairs as rows of one stream, from three."""
    return (moves.select(F.lit("batch").alias("activity_type"), *[c for c in moves.columns if c != "sale_item_id"])
            .unionByName(sold_items(sold, items, keep), allowMissingColumns=True))


def run_feed(stream: DataFrame, inv: Inventory, out: str, checkpoint: str, n: int, asof: AsOf | None = None,
             trigger: str | None = None):
    """X-3: after each micro-batch of ``feed_stream`` keep the newest ``n`` rows of R-15.

    The micro-batch goes through the report's own plan with the current batches, products and
    users, then is merged with the rows kept before: a movement delivered again, however late, has the
    same key and counts once, and a sale's items of several micro-batches add up. A sale that has left
    the newest n cannot come back, so its count is not needed. A replayed batch rewrites its own
    version. A batch with no row that shows writes its predecessor's rows again.
    """
    rest = [c for c in sales.FEED_COLS if c not in (*FEED_KEY, "items_count")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)      # read for movements, sales and items; it grows with the slice
        try:
            moves = (batch.where(F.col("activity_type") == "batch").dropDuplicates(["movement_id"])
                     .select(*[c for c in inv.movements.columns if c != "sale_item_id"]))
            pairs = batch.where(F.col("activity_type") == "sale")
            sold = (pairs.dropDuplicates(["sale_id"]).withColumnRenamed("movement_date", "sale_date")
                    .select("sale_id", "user_id", "total_amount", "payment_method", "sale_date"))
            rows = sales.feed_rows(inv.with_(movements=moves, sales=sold, sale_items=pairs.select("sale_id", "sale_item_id")),
                                   asof, n)
            prev = newest_version(batch.sparkSession, out, before=batch_id)
            if prev is not None:
                rows = (prev.unionByName(rows).groupBy(*FEED_KEY)
                        .agg(F.sum("items_count").alias("items_count"), F.max(F.struct(*rest)).alias("_r"))
                        .select(*FEED_KEY, "items_count", "_r.*"))
            (rows.orderBy(*sales.feed_order()).limit(n).withColumn("_version", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("_version").parquet(out))
        finally:
            batch.unpersist()

    return _start(stream, stream.writeStream.outputMode("append").foreachBatch(write)
                  .option("checkpointLocation", checkpoint), trigger)


def stream_feed(spark: SparkSession, inv: Inventory, asof: AsOf, n: int = 4, parts: int = 4,
                keep: str | None = None) -> DataFrame:
    """Replay movements, sales and sale items, each in its own time order, as three streams and
    return the labelled feed. Most items come after their sales."""
    landing, out, ckpt = replay_paths(spark, "feed")
    tables = {"moves": (inv.movements, "movement_date"), "sales": (inv.sales, "sale_date"),
              "items": (inv.sale_items.select("sale_id", "sale_item_id", "created_at"), "created_at")}
    slices = {name: time_slices(df, ts, parts) for name, (df, ts) in tables.items()}
    for i in range(parts):
        for name, (df, _) in tables.items():
            if i < len(slices[name]):
                df.where(slices[name][i]).write.mode("append").parquet(f"{landing}/{name}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{landing}/{name}") for name, (df, _) in tables.items()]
        run_feed(feed_stream(*streams, keep), inv, out, ckpt, n, asof)
    top = newest_version(spark, out)
    return sales.label_feed(sales.feed_rows(inv, asof, 0) if top is None else top, asof)


# ---- X-2 over the stock ledger itself ------------------------------------------------
LEDGER_FIELDS = ("movement_id", "batch_id", "movement_type", "quantity", "movement_date")
def ledger_stock(movements: DataFrame) -> DataFrame:
    """X-2 on the ledger: stock per batch as the running sum of signed movements.

    A movement id counts once however often and however late it is delivered: a balance may
    lose no row, so there is no watermark, and the ids seen stay in the state store (on
    disk), which grows with the ledger.
    """
    m = movements.dropDuplicates(["movement_id"])
    return m.groupBy("batch_id").agg(F.sum(F.col("quantity").cast("long")).alias("stock"),
                                     F.count(F.lit(1)).alias("movements"))


def run_ledger(stream: DataFrame, checkpoint: str, trigger: str | None = None):
    """Keep the balances of ``ledger_stock`` in the query's state; nothing else is written."""
    return _start(stream, stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint), trigger)


def ledger_balance(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch_id, stock, movements) as the last micro-batch left them: the rows of the aggregation's
    state, one a batch, read in parallel by state partition. No micro-batch's output is read again."""
    operators = spark.read.format("state-metadata").load(checkpoint).where("operatorName = 'stateStoreSave'")
    (aggregation,) = [r["operatorId"] for r in operators.select("operatorId").distinct().collect()]
    state = spark.read.format("statestore").option("operatorId", aggregation).load(checkpoint)
    return state.select("key.batch_id", F.col("value.sum").alias("stock"), F.col("value.count").alias("movements"))


def stream_ledger_stock(spark: SparkSession, movements: DataFrame, parts: int = 4) -> DataFrame:
    """Replay a ledger table in time order as a stream and return stock per batch."""
    landing, _, ckpt = replay_paths(spark, "ledger-stock")
    typed = movements.select(*LEDGER_FIELDS)
    replay_in_order(typed, "movement_date", landing, parts,
                    lambda: run_ledger(ledger_stock(spark.readStream.schema(typed.schema).parquet(landing)), ckpt))
    return ledger_balance(spark, ckpt)
