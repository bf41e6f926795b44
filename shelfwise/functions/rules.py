"""Named predicates: the stock rules of SURVEY 1.5 and filters F-1 .. F-11.

Each stock rule is a Boolean Column over a batch row (``quantity``, ``status``,
``expiry_date`` and its zero flag). Reports never inline a rule; they name it, so the
six meanings of "stock" stay distinct.

Predicates follow SQL three-valued logic (a zero date or NULL status gives NULL, which
filters treat as false) so they push down to Parquet; ``stock_rule`` is the null-safe
form for negation and output columns, ``stock_filter`` the pushable form for ``where``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import dates
from shelfwise.functions.dates import AsOf

# ---- fixed values (thresholds the reference's queries use) -------------------------
FRESH_MIN_DAYS = 365          # fresh: more than 365 days left
ACTIVE_MIN_DAYS = 360         # active360: days / 30 >= 12
EXPIRING_SOON_DAYS = (365, 545)
EXPIRING_VIEW_DAYS = 90
GOOD_STOCK_ABOVE = 50         # F-3 good > 50, low 1..50, out = 0
# -------------------------------------------------------------------------------------


def _qty():
    return F.col("quantity")


def _status():
    return F.col("status")


def fresh(asof: AsOf) -> Column:
    """status available and more than 365 days left (implies not expired)."""
    return (_status() == "available") & dates.after("expiry_date", asof.plus(FRESH_MIN_DAYS))


def unexpired(asof: AsOf) -> Column:
    return (_status() == "available") & dates.after("expiry_date", asof.day)


def allocatable(asof: AsOf) -> Column:
    return _status().isin("available", "low_stock") & dates.after("expiry_date", asof.day)


def active360(asof: AsOf) -> Column:
    """quantity > 0, available, not expired, at least 360 days left."""
    return ((_qty() > 0) & (_status() == "available")
            & dates.at_or_after("expiry_date", asof.plus(ACTIVE_MIN_DAYS)))


def on_hand() -> Column:
    return _qty() > 0


STOCK_RULES = {
    "fresh": fresh,
    "unexpired": unexpired,
    "allocatable": allocatable,
    "active360": active360,
    "on_hand": lambda asof: on_hand(),
}


def stock_rule(name: str, asof: AsOf) -> Column:
    """F-5 by name, never NULL; ``legacy`` is the stored column and has no predicate."""
    return F.coalesce(STOCK_RULES[name](asof), F.lit(False))


def stock_filter(name: str, asof: AsOf) -> Column:
    """F-5 by name for ``where``: the same rule, left pushable (NULL means false)."""
    return STOCK_RULES[name](asof)


# Letters that are a plain letter with marks, and that letter, by Unicode's own decomposition (Latin and its
# extensions); then the marks that stand alone, which fold to nothing.
_MARKED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
           if unicodedata.normalize("NFD", c) != c and c == c.lower()}
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def folded(text: Column) -> Column:
    """Text without case and accents, as the source's collation compares it."""
    return F.translate(F.lower(text), "".join(_MARKED) + _MARKS, "".join(_MARKED.values()))


def search(df: DataFrame, term: str | None, accent_insensitive: bool = True) -> DataFrame:
    """F-1: substring search on name or category, blind to case and (by default) to accents.

    Empty and ``"0"`` mean no filter (PHP truthiness). ``%`` and ``_`` typed by the user
    stay wildcards, as in the reference.
    """
    if not term or term == "0":
        return df
    if accent_insensitive:
        pattern = F.concat(F.lit("%"), folded(F.lit(term)), F.lit("%"))
        return df.where(F.like(folded(F.col("product_name")), pattern) | F.like(folded(F.col("category")), pattern))
    pattern = f"%{term}%"
    return df.where(F.col("product_name").ilike(pattern) | F.col("category").ilike(pattern))


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    """F-2: category equality, blind to case, accents and blanks at the end (as the source's collation
    has it); empty means no filter."""
    if not category or category == "0":
        return df
    return df.where(folded(F.rtrim(F.col("category"))) == folded(F.rtrim(F.lit(category))))


def by_stock_level(df: DataFrame, level: str | None, col: str = "total_stock") -> DataFrame:
    """F-3 on an aggregated stock column. ``high`` / ``medium`` have no rule: pass-through."""
    stock = F.col(col)
    if level == "good":
        return df.where(stock > GOOD_STOCK_ABOVE)
    if level == "low":
        return df.where(stock.between(1, GOOD_STOCK_ABOVE))
    if level == "out":
        return df.where(stock == 0)
    return df


def by_expiry_status(df: DataFrame, status: str | None, col: str = "status") -> DataFrame:
    """F-4: keep rows whose C-4 status equals the requested one."""
    if not status:
        return df
    return df.where(F.col(col) == F.lit(status))


def sales_on(asof: AsOf, col: str = "sale_date") -> Column:
    """F-6: half-open range on one calendar day (prunable, unlike ``DATE(col) =``)."""
    start = F.lit(asof.day).cast("timestamp")
    end = F.lit(asof.plus(1)).cast("timestamp")
    return (F.col(col) >= start) & (F.col(col) < end)


def movement_types(*types: str) -> Column:
    """F-7."""
    return F.col("movement_type").isin(*types)


def to_dispose(asof: AsOf) -> Column:
    """F-8: on hand and expired, zero-dated, or at most 365 days left."""
    return (_qty() > 0) & dates.at_or_before("expiry_date", asof.plus(FRESH_MIN_DAYS))


def expiring_soon(asof: AsOf) -> Column:
    """F-9: on hand with 365..545 days left (day 365 is also in F-8)."""
    lo, hi = EXPIRING_SOON_DAYS
    e = F.col("expiry_date")
    return (_qty() > 0) & (e >= F.lit(asof.plus(lo))) & (e <= F.lit(asof.plus(hi)))


def in_expiring_view(asof: AsOf) -> Column:
    """F-10: on hand, expiring within 90 days (or zero-dated), status not depleted.

    A NULL status fails ``<>`` as in SQL.
    """
    return ((_qty() > 0) & dates.at_or_before("expiry_date", asof.plus(EXPIRING_VIEW_DAYS))
            & (_status() != "depleted"))


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """F-11: rows passing every check, and the others with the first failed reason."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reject_reason", reason)
    ok = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull())
    return ok, bad


def non_empty(col: str) -> Column:
    return F.length(F.trim(F.col(col))) > 0
