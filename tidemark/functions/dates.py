"""Date semantics shared by every operator.

* Every age is relative to an explicit ``as_of`` date, never the wall clock.
* A day difference counts midnights crossed (``F.datediff`` on dates).
* Age predicates are written against the column (``d < as_of - n``) so the
  comparison reaches the Parquet scan and partition pruning.
* Free-text dates parse to NULL when they are junk, never to an error.
"""

from __future__ import annotations

import datetime as _dt
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = "str | _dt.date | Column"

# Extra layouts tried after the ISO cast (which also accepts a trailing time).
DEFAULT_DATE_FORMATS = ("MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy")


def as_date(value) -> Column:
    """Literal or column → DATE column."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, _dt.datetime):
        value = value.date()
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)


def to_day(c) -> Column:
    """Timestamp or date → DATE (truncation to the day)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("date")


def _date_or_col(v) -> Column:
    """Column, column name, or date literal (``date`` or ISO text) → Column."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        try:
            return F.lit(_dt.date.fromisoformat(v))
        except ValueError:
            return F.col(v)
    return as_date(v)


def day_diff(start, end) -> Column:
    """Days from ``start`` to ``end``, counting midnights (INT)."""
    return F.datediff(_date_or_col(end), _date_or_col(start))


def older_than(c, as_of, days: int) -> Column:
    """``day_diff(c, as_of) > days`` in sargable form: ``c < as_of - days``.

    Equal to the day-difference form for DATE columns and for timestamps
    (``ts < midnight of day X`` iff ``date(ts) < X``). The raw column is
    compared, so the predicate is pushed to the scan.
    """
    c = F.col(c) if isinstance(c, str) else c
    return c < F.date_sub(as_date(as_of), days)


def on_or_after(c, as_of, days_back: int) -> Column:
    """Lookback window ``c >= as_of - days_back`` (timestamp compared to midnight)."""
    c = F.col(c) if isinstance(c, str) else c
    return c >= F.date_sub(as_date(as_of), days_back)


def due_within(c, as_of, days: int) -> Column:
    """Inclusive ``as_of <= c <= as_of + days``."""
    c = F.col(c) if isinstance(c, str) else c
    a = as_date(as_of)
    return c.between(a, F.date_add(a, days))


def parse_date(c, formats: Iterable[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Lenient text → DATE; unparseable text becomes NULL.

    A full year-month-day must lead (a time may follow it): a bare year or
    month is not a date.
    """
    c = F.col(c) if isinstance(c, str) else c
    iso = F.when(c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}(\s*$|[ T])"), F.try_to_date(c))
    return F.coalesce(iso, *[F.try_to_date(c, f) for f in formats])


def quarter_end(d) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def year_end(d) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def feed_as_of(df: DataFrame, date_col: str) -> Column:
    """Latest date of a feed as a scalar subquery column (stays in one plan)."""
    return df.select(F.max(to_day(date_col))).scalar()
