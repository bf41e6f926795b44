"""The as-of clock and zero-date aware date predicates.

No query reads the wall clock: "today" is ``AsOf.day`` and "now" is ``AsOf.now``.
Predicates against a literal day are written in range form (``expiry > day + n``) so
Parquet min/max statistics can skip row groups; ``datediff`` is only computed for
output columns.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AsOf:
    day: dt.date
    now: dt.datetime

    @staticmethod
    def of(day, now=None) -> "AsOf":
        if isinstance(day, str):
            day = dt.date.fromisoformat(day)
        if now is None:
            now = dt.datetime.combine(day, dt.time())
        elif isinstance(now, str):
            now = dt.datetime.fromisoformat(now)
        return AsOf(day, now)

    def plus(self, days: int) -> dt.date:
        return self.day + dt.timedelta(days=days)

    @property
    def d(self) -> Column:
        return F.lit(self.day)

    @property
    def t(self) -> Column:
        # Parsed as text in the session time zone, like every date-to-timestamp cast, so
        # "now" and stored midnights agree whatever zone the Python process runs in.
        return F.to_timestamp(F.lit(self.now.isoformat(sep=" ")))

    @property
    def has_time(self) -> bool:
        """True when "now" is after midnight of "today" (PHP/JS compare instants)."""
        return self.now > dt.datetime.combine(self.day, dt.time())


def is_zero(col: str) -> Column:
    """Null-safe zero-date flag (for negation and output columns)."""
    return F.coalesce(F.col(f"{col}_zero"), F.lit(False))


# The comparisons below use SQL three-valued logic: a zero date compares as NULL, which
# ``where`` and ``when`` treat as false. They stay plain column-vs-literal comparisons
# (OR the raw zero flag) so Parquet can push them down and skip row groups; wrap them in
# ``coalesce(.., false)`` only where a result is negated or emitted as a column.
def before(col: str, day: dt.date) -> Column:
    """``col < day`` with a zero date counting as before everything."""
    return F.col(f"{col}_zero") | (F.col(col) < F.lit(day))


def after(col: str, day: dt.date) -> Column:
    """``col > day``; a zero date is never after anything."""
    return F.col(col) > F.lit(day)


def at_or_after(col: str, day: dt.date) -> Column:
    return F.col(col) >= F.lit(day)


def at_or_before(col: str, day: dt.date) -> Column:
    """``col <= day`` with a zero date counting as before everything."""
    return F.col(f"{col}_zero") | (F.col(col) <= F.lit(day))


def days_left(col: str, asof: AsOf) -> Column:
    """C-1: whole days from today to the date; NULL for a zero date."""
    return F.datediff(F.col(col), asof.d)


def midnight_passed(col: str, asof: AsOf) -> Column:
    """PHP ``$today > new DateTime($date)``: now is after midnight of the date.

    A zero date parses to a date in year -1, so it has always passed.
    """
    return is_zero(col) | (asof.t > F.col(col).cast("timestamp"))


def whole_days_until(col: str, asof: AsOf) -> Column:
    """PHP ``$now->diff($date)->days`` for a date still ahead: floor of elapsed days."""
    secs = F.unix_timestamp(F.col(col).cast("timestamp")) - F.unix_timestamp(asof.t)
    return F.floor(secs / F.lit(86400)).cast("long")


def calendar_months_left(col: str, asof: AsOf) -> Column:
    """C-5: ``y*12 + m + d/30`` of the calendar difference from now to the date.

    Counting from an instant after midnight loses the partial day, so the difference is
    taken to the day before the date. Full months come from ``months_between`` floored,
    the remaining days from the date ``add_months`` lands on.
    """
    end = F.date_sub(F.col(col), 1) if asof.has_time else F.col(col)
    full = F.floor(F.months_between(end, asof.d)).cast("int")
    rest = F.datediff(end, F.add_months(asof.d, full))
    return full.cast("double") + rest.cast("double") / F.lit(30.0)


def zero_aware_min(col: str, cond: Column | None = None) -> tuple[Column, Column]:
    """``MIN`` where a zero date wins: returns (min of real dates, any zero flag)."""
    value = F.col(col) if cond is None else F.when(cond, F.col(col))
    zero = is_zero(col) if cond is None else (cond & is_zero(col))
    return F.min(value), F.coalesce(F.max(zero.cast("int")) == F.lit(1), F.lit(False))
