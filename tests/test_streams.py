"""Streams equal their batch counterparts; repeated deliveries count once; late rows drop."""

import datetime as dt

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from shelfwise.streaming import streams
from conftest import SF001

BASE = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, "
                                       "value double, props string")


def test_daily_sales_matches_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = {r.day: (round(r.total_sales, 6), r.sales_count) for r in streams.stream_daily_sales(spark, ev).collect()}
    want = {r.day: (round(r.t, 6), r.n) for r in ev.where("event_type = 'purchase'")
            .groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("t"), F.count("*").alias("n")).collect()}
    assert got == want


def test_repeated_delivery_counts_once_and_late_rows_drop(spark):
    rows = [(1, BASE + dt.timedelta(hours=1), 7, "purchase", 10.0, None),
            (2, BASE + dt.timedelta(hours=2), 7, "signup", 0.0, None),
            (3, BASE + dt.timedelta(days=2), 7, "purchase", 5.0, None)]
    # the same events delivered again, in time order
    ev = streams.typed_events(_events(spark, rows + [rows[0], rows[2]]))
    landing, out, ckpt = streams.replay_paths(spark, "late-test")
    run = lambda: streams.run_update(streams.daily_sales(streams.read_events(spark, landing)), out, ckpt)
    streams.replay_in_order(ev, "ts", landing, 2, run)
    # an event 2 days older than the newest arrives after the stream has moved on: late
    late = streams.typed_events(_events(spark, [(4, BASE + dt.timedelta(hours=3), 7, "purchase", 99.0, None)]))
    late.write.mode("append").parquet(landing)
    run()
    got = {r.day: (r.total_sales, r.sales_count) for r in
           streams.latest(spark, out, ["day"], streams.DAILY_SCHEMA).collect()}
    assert got == {dt.date(2024, 1, 1): (10.0, 1), dt.date(2024, 1, 3): (5.0, 1)}


def test_running_stock_and_activity_match_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = {r.user_id: r.stock for r in streams.stream_running_stock(spark, ev).collect()}
    want = {r.user_id: r.s for r in ev.where("event_type in ('purchase','signup')").groupBy("user_id")
            .agg(F.sum(F.when(F.col("event_type") == "purchase", -1).otherwise(1)).alias("s")).collect()}
    assert got == want
    users = spark.read.parquet(f"{SF001}/customer.parquet").select(F.col("c_custkey").alias("id"),
                                                                   F.col("c_name").alias("username"))
    top = [r.event_id for r in streams.stream_activity(spark, ev, users, n=5).orderBy(F.col("ts").desc()).collect()]
    want_top = [r.event_id for r in ev.where("event_type in ('purchase','error')")
                .join(users.withColumnRenamed("id", "user_id"), "user_id")
                .orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(5).collect()]
    assert top == want_top


def test_ledger_stream_matches_batch_and_dedupes(spark):
    from shelfwise.sources.tables import load
    inv = load(spark, __file__.rsplit("/", 1)[0] + "/fixtures/dump", fmt="csv")
    moves = inv.movements.unionByName(inv.movements.where("movement_id in ('1', '55')"))   # repeated rows
    got = {r.batch_id: r.stock for r in streams.stream_ledger_stock(spark, moves, parts=3).collect()}
    want = {r.batch_id: r.s for r in inv.movements.groupBy("batch_id").agg(F.sum("quantity").alias("s")).collect()}
    assert got == want
    qty = {r.batch_id: r.quantity for r in inv.batches.collect()}
    assert all(got[b] == qty[b] for b in got)


def test_continuous_trigger_starts_and_stops(spark):
    ev = streams.typed_events(_events(spark, [(1, BASE, 7, "purchase", 3.0, None)]))
    landing, out, ckpt = streams.replay_paths(spark, "live")
    ev.write.mode("append").parquet(landing)
    q = streams.run_update(streams.daily_sales(streams.read_events(spark, landing)), out, ckpt,
                           trigger="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    got = streams.latest(spark, out, ["day"], streams.DAILY_SCHEMA).collect()
    assert [(r.day, r.total_sales) for r in got] == [(BASE.date(), 3.0)]


def test_ledger_stream_keeps_late_movements(spark):
    kind = "movement_id string, batch_id string, movement_type string, quantity int, movement_date timestamp"
    now = spark.createDataFrame([("m2", "b", "sale", -2, BASE + dt.timedelta(days=40))], kind)
    late = spark.createDataFrame([("m1", "b", "restock", 9, BASE), ("m3", "c", "restock", 4, BASE)], kind)
    landing, _, ckpt = streams.replay_paths(spark, "late-ledger")
    for delivery in (now, late, late, now):
        delivery.write.mode("append").parquet(landing)
        streams.run_ledger(streams.ledger_stock(spark.readStream.schema(now.schema).parquet(landing)), ckpt)
    held = streams.ledger_balance(spark, ckpt).collect()  # one row a batch, whatever the number of micro-batches
    assert sorted(tuple(r) for r in held) == [("b", 7, 2), ("c", 4, 1)]


def test_ledger_stream_of_an_empty_table(spark):
    kind = "movement_id long, batch_id long, movement_type string, quantity int, movement_date timestamp"
    got = streams.stream_ledger_stock(spark, spark.createDataFrame([], kind))
    assert got.collect() == [] and got.schema["batch_id"].dataType.simpleString() == "bigint"


def _feed(spark, inv, deliveries, keep=None, n=4):
    """Deliver (moves, sales, items) rows step by step; the feed's sales after each step."""
    landing, out, ckpt = streams.replay_paths(spark, "late-items")
    frames = {"moves": inv.movements, "sales": inv.sales, "items": inv.sale_items.select("sale_id", "sale_item_id", "created_at")}
    seen = []
    for step in deliveries:
        for name, df in frames.items():
            df.where(step.get(name, "false")).write.mode("append").parquet(f"{landing}/{name}")
        reads = [spark.readStream.schema(df.schema).parquet(f"{landing}/{name}") for name, df in frames.items()]
        streams.run_feed(streams.feed_stream(*reads, keep), inv, out, ckpt, n)
        top = streams.newest_version(spark, out)
        seen.append(sorted((r.activity_type, r.sale_id or r.movement_id, r.items_count) for r in top.collect()) if top else [])
    return seen


@pytest.fixture(scope="module")
def shop(spark):
    from shelfwise.sources.tables import Inventory, conform
    day = lambda h: BASE + dt.timedelta(hours=h)
    make = lambda name, rows, kind: conform(name, spark.createDataFrame(rows, kind))
    return Inventory(
        make("products", [(1, "P", "C")], "product_id long, product_name string, category string"),
        make("product_batches", [(7, 1, "B")], "batch_id long, product_id long, batch_number string"),
        make("batch_movements", [(1, 7, "restock", 5, day(1))], "movement_id long, batch_id long, movement_type string, quantity int, movement_date timestamp"),
        make("sales", [(1, 1, day(2)), (2, 1, day(3)), (3, 9, day(4)), (4, 1, day(90))], "sale_id long, user_id long, sale_date timestamp"),
        make("sale_items", [(11, 1, day(2)), (12, 1, day(2)), (21, 2, day(50)), (31, 3, day(4)), (41, 4, day(90))],
             "sale_item_id long, sale_id long, created_at timestamp"),
        make("users", [(1, "u")], "id long, username string"))


def test_a_sale_delivered_before_its_items_appears(spark, shop):
    steps = [{"moves": "true", "sales": "sale_id <= 3"}, {"items": "sale_item_id = 11"},
             {"items": "sale_item_id in (11, 12, 31)", "sales": "sale_id = 1", "moves": "true"}, {"items": "sale_item_id = 21"}]
    move = ("batch", 1, None)
    assert _feed(spark, shop, steps) == [[move], [move, ("sale", 1, 1)], [move, ("sale", 1, 2)], [move, ("sale", 1, 2), ("sale", 2, 1)]]


def test_items_before_their_sale_and_state_that_is_forgotten(spark, shop):
    steps = [{"items": "sale_item_id in (11, 12)"}, {"sales": "sale_id in (1, 2)"},
             {"sales": "sale_id = 4", "items": "sale_item_id = 41"}, {"items": "sale_item_id = 21"}]
    kept = _feed(spark, shop, steps, keep="10 hours")
    # item 21 lies 47 hours after its sale: too far with a bound of 10 hours, no matter without
    assert kept == [[], [("sale", 1, 2)], [("sale", 1, 2), ("sale", 4, 1)], [("sale", 1, 2), ("sale", 4, 1)]]
    assert _feed(spark, shop, steps)[-1] == [("sale", 1, 2), ("sale", 2, 1), ("sale", 4, 1)]


def test_state_rests_on_disk_whatever_the_session_has(spark):
    """Spark's default keeps the state on the heap; the stream takes RocksDB, and the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    moves = spark.createDataFrame([("a", "b1", "restock", 5, BASE), ("b", "b1", "sale", -2, BASE + dt.timedelta(days=9)),
                                   ("a", "b1", "restock", 5, BASE + dt.timedelta(days=3))],
                                  "movement_id string, batch_id string, movement_type string, quantity int, movement_date timestamp")
    was = spark.conf.get(key)
    spark.conf.set(key, streams.HEAP_STATE)
    try:
        landing, _, ckpt = streams.replay_paths(spark, "heap-test")
        moves.write.parquet(landing)
        streams.run_ledger(streams.ledger_stock(spark.readStream.schema(moves.schema).parquet(landing)), ckpt)
        assert spark.conf.get(key) == streams.HEAP_STATE
        assert [tuple(r) for r in streams.ledger_balance(spark, ckpt).collect()] == [("b1", 3, 2)]
        told = "".join(r.value for r in spark.read.text(f"{ckpt}/offsets/0").collect())
        assert "RocksDBStateStoreProvider" in told and "HDFSBacked" not in told
    finally:
        spark.conf.set(key, was)


def test_a_feeds_state_and_micro_batches_stay_off_the_heap(spark, shop, monkeypatch):
    """A join keeps one store a partition, not four; what a micro-batch holds is kept on disk while it is read."""
    levels, paths = [], []
    kind, replay = type(shop.sales), streams.replay_paths
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, *level: levels.append(level) or persist(df, *level))
    monkeypatch.setattr(streams, "replay_paths", lambda *a: paths.append(replay(*a)) or paths[-1])
    key = "spark.sql.streaming.join.stateFormatVersion"
    was = spark.conf.get(key, None)
    assert _feed(spark, shop, [{"sales": "true", "items": "true"}]) == [[("sale", 1, 2), ("sale", 2, 1), ("sale", 4, 1)]]
    assert levels == [(StorageLevel.DISK_ONLY,)] and spark.conf.get(key, None) == was
    stores = spark.read.format("state-metadata").load(paths[0][2]).where("operatorName = 'symmetricHashJoin'")
    assert stores.select("stateStoreName").distinct().count() == 1
