"""Scalar expressions C-1 .. C-21 as Column builders (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import dates
from shelfwise.functions.dates import AsOf
from shelfwise.sources.schemas import LOW_STOCK_BATCH_UNITS

# ---- fixed values (labels and thresholds of the reference) --------------------------
URGENCY = (("CRITICAL", 7), ("URGENT", 30), ("WARNING", 90))
EXPIRING_STATUS_DAYS = 180
NEAR_EXPIRY_MONTHS = 12
SUMMARY_GOOD_ABOVE, SUMMARY_LOW_FROM = 200, 50
ACTIONS = {"restock": "Updated Stock", "expiry": "Disposed Expired Batch",
           "other": "Disposed Damaged Batch", "sale": "Processed Sale"}
DAYPARTS = (("morning", 5, 11), ("afternoon", 12, 17))   # anything else: evening
# ---------------------------------------------------------------------------------------


def urgency(asof: AsOf) -> Column:
    """C-2: EXPIRED before today (or zero date), then CRITICAL / URGENT / WARNING / OK."""
    d = dates.days_left("expiry_date", asof)
    expr = F.when(dates.before("expiry_date", asof.day), F.lit("EXPIRED"))
    for label, limit in URGENCY:
        expr = expr.when(d <= limit, F.lit(label))
    return expr.otherwise(F.lit("OK"))


def batch_status(asof: AsOf) -> Column:
    """C-3 (the trigger): depleted, expired, low_stock, available, in that order."""
    q = F.col("quantity")
    return (F.when(q == 0, F.lit("depleted"))
             .when(dates.before("expiry_date", asof.day), F.lit("expired"))
             .when(q <= LOW_STOCK_BATCH_UNITS, F.lit("low_stock"))
             .otherwise(F.lit("available")))


def product_expiry_status(asof: AsOf, col: str = "status_date") -> Column:
    """C-4 on a date column (nearest fresh expiry, else the product's own date).

    expired when now is past midnight of the date; expiring when at most 180 whole days
    remain; fresh otherwise or without a date.
    """
    return (F.when(F.col(col).isNull() & ~dates.is_zero(col), F.lit("fresh"))
             .when(dates.midnight_passed(col, asof), F.lit("expired"))
             .when(dates.whole_days_until(col, asof) <= EXPIRING_STATUS_DAYS, F.lit("expiring"))
             .otherwise(F.lit("fresh")))


def batch_badge(asof: AsOf, col: str = "earliest_expiry") -> Column:
    """C-5 from the earliest on-hand expiry: expired / near-expiry / fresh."""
    months = dates.calendar_months_left(col, asof)
    return (F.when(F.col(col).isNull() & ~dates.is_zero(col), F.lit("fresh"))
             .when(dates.midnight_passed(col, asof), F.lit("expired"))
             .when(months < NEAR_EXPIRY_MONTHS, F.lit("near-expiry"))
             .otherwise(F.lit("fresh")))


def card_status(days: Column, in_use: Column, zero: Column) -> Column:
    """C-6 on days left (rounded up; equal to the date difference for a date-only day)."""
    return (F.when(zero | (days < 0), F.lit("Expired"))
             .when(days / F.lit(30.0) < NEAR_EXPIRY_MONTHS, F.lit("Near Expiry"))
             .when(in_use, F.lit("In Use"))
             .otherwise(F.lit("Available")))


def summary_label(total: Column) -> Column:
    """C-7."""
    return (F.when(total > SUMMARY_GOOD_ABOVE, F.lit("Good Stock"))
             .when(total >= SUMMARY_LOW_FROM, F.lit("Low in Stock"))
             .otherwise(F.lit("Critical Stock")))


def stock_class(stock: Column, reorder_level: Column) -> Column:
    """C-8."""
    return (F.when(stock > reorder_level, F.lit("status-green"))
             .when(stock > 0, F.lit("status-orange"))
             .otherwise(F.lit("status-red")))


def repurchase_colour(stock: Column) -> Column:
    """C-9."""
    return F.when(stock == 0, F.lit("red")).otherwise(F.lit("orange"))


def overall_status(to_dispose: Column, out_of_stock: Column,
                   expiring_soon: Column, low_stock: Column) -> tuple[Column, Column]:
    """C-10: (status, colour) of the KPI row."""
    critical = (to_dispose > 0) | (out_of_stock > 0)
    warning = (expiring_soon > 0) | (low_stock > 0)
    status = F.when(critical, F.lit("Critical")).when(warning, F.lit("Warning")).otherwise(F.lit("Good"))
    colour = F.when(critical, F.lit("red")).when(warning, F.lit("orange")).otherwise(F.lit("green"))
    return status, colour


def time_ago(ts: Column, asof: AsOf) -> Column:
    """C-11: minutes, hours or days since ``ts``, floored."""
    minutes = (F.unix_timestamp(asof.t) - F.unix_timestamp(ts)).cast("double") / F.lit(60.0)
    return (F.when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit(" mins ago")))
             .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hrs ago")))
             .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" days ago"))))


def action_label(activity_type: Column, movement_type: Column) -> Column:
    """C-12."""
    return (F.when(activity_type == "sale", F.lit(ACTIONS["sale"]))
             .when(movement_type == "restock", F.lit(ACTIONS["restock"]))
             .when(movement_type == "expiry", F.lit(ACTIONS["expiry"]))
             .otherwise(F.lit(ACTIONS["other"])))


def user_or(username: Column, viewer: str) -> Column:
    """C-13: the username, or the viewer when NULL or empty."""
    return F.coalesce(F.nullif(username, F.lit("")), F.lit(viewer))


def money_text(amount: Column) -> Column:
    """C-14: two decimals with thousands separators, rounded half up first."""
    return F.format_number(F.round(amount.cast("decimal(38,4)"), 2), 2)


def peso_text(amount: Column) -> Column:
    """C-14 with the currency sign; NULL for NULL."""
    return F.concat(F.lit("₱"), money_text(amount))


def ucfirst(c: Column) -> Column:
    """C-15: upper-case the first letter only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def padded_id(prefix: str, n: Column) -> Column:
    """C-16: ``prefix`` + at least three digits (four digits are not truncated)."""
    return F.concat(F.lit(prefix), F.format_string("%03d", n.cast("long")))


def batch_code(product_id: Column, seq: Column) -> Column:
    """C-16 batch numbers: ``BTH-`` + product id + three-digit sequence."""
    return F.concat(F.lit("BTH-"), product_id.cast("string"), F.format_string("%03d", seq.cast("long")))


def non_negative(x: Column) -> Column:
    """C-17 ``GREATEST(0, x)`` with SQL NULL semantics."""
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0), x))


def daypart(ts: Column) -> Column:
    """C-20: morning 5-11, afternoon 12-17, else evening."""
    h = F.hour(ts)
    expr = None
    for name, lo, hi in DAYPARTS:
        cond = h.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("evening"))


def time_text(ts: Column) -> Column:
    """C-21 time of day, ``hh:mm AM``."""
    return F.date_format(ts, "hh:mm a")


def date_text(d: Column) -> Column:
    """C-21 date, ``Mon dd, yyyy``; ``N/A`` when NULL."""
    return F.coalesce(F.date_format(d, "MMM dd, yyyy"), F.lit("N/A"))
