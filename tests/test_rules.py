"""Layer 1: rules and labels at their boundaries (days, units, zero dates, NULLs)."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions import labels, rules
from shelfwise.functions.dates import AsOf

DAY = dt.date(2025, 11, 17)
ASOF = AsOf.of(DAY, dt.datetime(2025, 11, 17, 10, 0))
SCHEMA = "batch_id string, quantity int, status string, expiry_date date, expiry_date_zero boolean"


def _batches(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _at(days):
    return DAY + dt.timedelta(days=days)


def _eval(spark, rows, col):
    # predicates use SQL logic: NULL (unknown) acts as false in filters
    df = _batches(spark, rows).select("batch_id", col.alias("v"))
    boolean = df.schema["v"].dataType.typeName() == "boolean"
    return {r.batch_id: (bool(r.v) if boolean else r.v) for r in df.collect()}


def test_stock_rule_day_boundaries(spark):
    days = [-1, 0, 1, 359, 360, 365, 366]
    rows = [(str(d), 20, "available", _at(d), False) for d in days] + [("zero", 20, "available", None, True)]
    fresh = _eval(spark, rows, rules.stock_rule("fresh", ASOF))
    assert [fresh[str(d)] for d in days] == [False, False, False, False, False, False, True]
    assert fresh["zero"] is False
    unexp = _eval(spark, rows, rules.stock_rule("unexpired", ASOF))
    assert [unexp[str(d)] for d in days] == [False, False, True, True, True, True, True]
    active = _eval(spark, rows, rules.stock_rule("active360", ASOF))
    assert [active[str(d)] for d in days] == [False, False, False, False, True, True, True]
    assert active["zero"] is False


def test_allocatable_includes_low_stock_and_null_status_is_excluded(spark):
    rows = [("a", 5, "low_stock", _at(10), False), ("b", 5, "expired", _at(10), False),
            ("c", 5, None, _at(10), False), ("d", 50, "available", _at(10), False)]
    alloc = _eval(spark, rows, rules.stock_rule("allocatable", ASOF))
    assert alloc == {"a": True, "b": False, "c": False, "d": True}
    assert _eval(spark, rows, rules.stock_rule("unexpired", ASOF))["a"] is False


def test_dispose_and_expiring_soon_overlap_at_365(spark):
    days = [-5, 364, 365, 366, 545, 546]
    rows = [(str(d), 3, "available", _at(d), False) for d in days] + [("zero", 3, "available", None, True),
                                                                       ("empty", 0, "available", _at(1), False)]
    disp = _eval(spark, rows, rules.to_dispose(ASOF))
    soon = _eval(spark, rows, rules.expiring_soon(ASOF))
    assert [disp[str(d)] for d in days] == [True, True, True, False, False, False]
    assert [soon[str(d)] for d in days] == [False, False, True, True, True, False]
    assert disp["zero"] is True and soon["zero"] is False and disp["empty"] is False


def test_expiring_view_window(spark):
    rows = [("90", 1, "available", _at(90), False), ("91", 1, "available", _at(91), False),
            ("dep", 1, "depleted", _at(5), False), ("nul", 1, None, _at(5), False),
            ("zero", 1, "available", None, True)]
    v = _eval(spark, rows, rules.in_expiring_view(ASOF))
    assert v == {"90": True, "91": False, "dep": False, "nul": False, "zero": True}


def test_urgency_levels(spark):
    days = [-1, 0, 7, 8, 30, 31, 90, 91]
    rows = [(str(d), 1, "available", _at(d), False) for d in days] + [("zero", 1, "available", None, True)]
    u = _eval(spark, rows, labels.urgency(ASOF))
    assert [u[str(d)] for d in days] == ["EXPIRED", "CRITICAL", "CRITICAL", "URGENT", "URGENT", "WARNING",
                                         "WARNING", "OK"]
    assert u["zero"] == "EXPIRED"


def test_batch_status_trigger_order(spark):
    rows = [("q0", 0, None, _at(-3), False), ("exp", 50, None, _at(-1), False), ("low10", 10, None, _at(3), False),
            ("ok11", 11, None, _at(3), False), ("zero", 50, None, None, True)]
    s = _eval(spark, rows, labels.batch_status(ASOF))
    assert s == {"q0": "depleted", "exp": "expired", "low10": "low_stock", "ok11": "available", "zero": "expired"}


def _dates(spark, values, col="d"):
    return spark.createDataFrame([(str(i), v, v is None) for i, v in enumerate(values)],
                                 f"k string, {col} date, {col}_zero boolean")


def test_product_expiry_status_compares_instants(spark):
    values = [_at(0), _at(1), _at(180), _at(181), _at(182), _at(-1)]
    df = _dates(spark, values).select("k", labels.product_expiry_status(ASOF, "d").alias("s"))
    got = {r.k: r.s for r in df.collect()}
    # today at 10:00 is past midnight of today: expired; tomorrow is 0 whole days away
    assert [got[str(i)] for i in range(len(values))] == ["expired", "expiring", "expiring", "expiring", "fresh",
                                                        "expired"]


def test_badge_counts_calendar_months_from_the_instant(spark):
    # from 2025-11-17 10:00: 2026-11-17 is 11 months 30 days 14 h away -> 12.0 months -> fresh;
    # 2026-11-16 is 11 months 29 days 14 h away -> 11.97 months -> near-expiry
    values = [dt.date(2026, 11, 17), dt.date(2026, 11, 16), dt.date(2027, 3, 1), _at(0), _at(1)]
    df = _dates(spark, values, "e").select("k", labels.batch_badge(ASOF, "e").alias("b"))
    got = {r.k: r.b for r in df.collect()}
    assert [got[str(i)] for i in range(len(values))] == ["fresh", "near-expiry", "fresh", "expired", "near-expiry"]


def test_badge_of_zero_date_and_no_date(spark):
    df = spark.createDataFrame([("zero", None, True), ("none", None, False)], "k string, e date, e_zero boolean")
    got = {r.k: r.b for r in df.select("k", labels.batch_badge(ASOF, "e").alias("b")).collect()}
    assert got == {"zero": "expired", "none": "fresh"}


def test_scalar_labels(spark):
    df = spark.createDataFrame([(1, 2.005, "gcash", 5, None), (1234, 1234567.125, "cash", 12, "")],
                               "n long, amount double, pm string, hour int, uname string")
    ts = F.make_timestamp(F.lit(2025), F.lit(11), F.lit(17), F.col("hour"), F.lit(5), F.lit(0))
    out = df.select(labels.padded_id("TXN-", F.col("n")).alias("txn"),
                    labels.money_text(F.col("amount").cast("decimal(12,3)")).alias("money"),
                    labels.ucfirst(F.col("pm")).alias("pm"), labels.daypart(ts).alias("part"),
                    labels.time_text(ts).alias("tt"), labels.user_or(F.col("uname"), "viewer").alias("user")).collect()
    assert [r.txn for r in out] == ["TXN-001", "TXN-1234"]
    assert [r.money for r in out] == ["2.01", "1,234,567.13"]           # half up, not half even
    assert [r.pm for r in out] == ["Gcash", "Cash"]
    assert [r.part for r in out] == ["morning", "afternoon"]
    assert [r.tt for r in out] == ["05:05 AM", "12:05 PM"]
    assert [r.user for r in out] == ["viewer", "viewer"]


def test_time_ago_units(spark):
    mins = [0, 59, 60, 1439, 1440, 2880]
    base = dt.datetime(2025, 11, 17, 10, 0)
    df = spark.createDataFrame([(m, base - dt.timedelta(minutes=m)) for m in mins], "m int, ts timestamp")
    got = {r.m: r.t for r in df.select("m", labels.time_ago(F.col("ts"), ASOF).alias("t")).collect()}
    assert [got[m] for m in mins] == ["0 mins ago", "59 mins ago", "1 hrs ago", "23 hrs ago", "1 days ago",
                                      "2 days ago"]


def test_search_and_category_filters(spark):
    df = spark.createDataFrame([("Amoxicillin", "Prescription Medicines"), ("Gauze", "Medical Supplies"),
                                ("BLUE pill", "OTC")], "product_name string, category string")
    assert rules.search(df, "").count() == 3 and rules.search(df, "0").count() == 3
    assert rules.search(df, "blue").count() == 1
    assert rules.search(df, "medic").count() == 2
    assert rules.search(df, "a_o").count() == 1          # '_' stays a wildcard
    assert rules.by_category(df, "OTC").count() == 1 and rules.by_category(df, None).count() == 3


def test_null_reorder_level_is_dropped_by_having(spark):
    from shelfwise.plans.reports import reorder_list
    from shelfwise.sources.tables import Inventory, conform
    products = conform("products", spark.createDataFrame(
        [(1, "a", "c", 1.0, 0, 10), (2, "b", "c", 1.0, 0, None)],
        "product_id long, product_name string, category string, price double, current_stock int, reorder_level int"))
    batches = conform("product_batches", spark.createDataFrame([], "batch_id string, product_id long"))
    empty = spark.createDataFrame([], "x int")
    inv = Inventory(products, batches, empty, empty, empty, empty)
    assert [r.product_id for r in reorder_list(inv, ASOF).collect()] == [1]


def test_accent_insensitive_search(spark):
    df = spark.createDataFrame([("Paracétamol", "OTC"), ("Ibuprofen", "OTC")], "product_name string, category string")
    assert rules.search(df, "paracetamol", accent_insensitive=False).count() == 0
    assert rules.search(df, "PARACETAMOL").count() == 1
    assert rules.search(df, "pära%t_mòl").count() == 1 and rules.search(df, "para_tamol").count() == 0  # wildcards


def test_text_folds_as_the_collation_does(spark):
    pairs = [("CRÈME brûlée", "creme brulee"), ("e\u0301té", "ete"), ("Ệ", "e"), ("Łódź", "łodz"), ("ñ%_", "n%_"), ("漢字", "漢字")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.x == r.b for r in df.select(rules.folded(df.a).alias("x"), "b").collect())
    named = spark.createDataFrame([("Santé ",), ("sante",), ("SANTÉ",), ("santés",)], "category string")
    assert named.transform(rules.by_category, "sanTè  ").count() == 3


def test_sql_function_matches_available_stock(spark):
    from shelfwise.plans import reports
    from shelfwise.sources.tables import load
    inv = load(spark, __file__.rsplit("/", 1)[0] + "/fixtures/dump", fmt="csv")
    reports.register_sql_functions(inv, ASOF)
    inv.products.createOrReplaceTempView("products_t")
    got = {r.product_id: r.a for r in spark.sql(
        "SELECT product_id, available_stock(product_id) AS a FROM products_t").collect()}
    want = {r.product_id: r.available for r in reports.available_stock(inv, ASOF).collect()}
    assert got == want and sum(got.values()) == 4390


def test_unit_thresholds(spark):
    df = spark.createDataFrame([(u, 50) for u in (0, 1, 49, 50, 51, 200, 201)], "u long, lvl int")
    out = df.select("u", labels.summary_label(F.col("u")).alias("s"),
                    labels.stock_class(F.col("u"), F.col("lvl")).alias("c"),
                    labels.repurchase_colour(F.col("u")).alias("r")).collect()
    got = {r.u: (r.s, r.c, r.r) for r in out}
    assert got[0] == ("Critical Stock", "status-red", "red")
    assert got[1] == ("Critical Stock", "status-orange", "orange")
    assert got[49] == ("Critical Stock", "status-orange", "orange")
    assert got[50] == ("Low in Stock", "status-orange", "orange")
    assert got[51] == ("Low in Stock", "status-green", "orange")
    assert got[200] == ("Low in Stock", "status-green", "orange")
    assert got[201] == ("Good Stock", "status-green", "orange")


def test_overall_status_levels(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)],
                               "d long, o long, e long, l long")
    status, colour = labels.overall_status(F.col("d"), F.col("o"), F.col("e"), F.col("l"))
    got = [(r.s, r.c) for r in df.select(status.alias("s"), colour.alias("c")).collect()]
    assert got == [("Critical", "red"), ("Critical", "red"), ("Warning", "orange"), ("Warning", "orange"),
                   ("Good", "green")]


def test_card_status_and_in_use(spark):
    days = F.col("d")
    df = spark.createDataFrame([(-1, False, False), (359, True, False), (360, True, False), (360, False, False),
                                (None, False, True)], "d int, iu boolean, z boolean")
    got = [r.s for r in df.select(labels.card_status(days, F.col("iu"), F.col("z")).alias("s")).collect()]
    assert got == ["Expired", "Near Expiry", "In Use", "Available", "Expired"]
