"""Predicate and projection helpers (FLT-*, PRJ-*, FN-*)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import TELEMETRY_PREFIX


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_or_empty(c) -> Column:
    """``c IS NULL OR c = ''``."""
    c = col(c)
    return c.isNull() | (c == "")


def not_deleted(c="_fivetran_deleted") -> Column:
    """Soft-delete filter, ``flag = FALSE`` (NULL drops, as in SQL)."""
    return col(c) == F.lit(False)


def telemetry_key(id_col) -> Column:
    """``concat('platform:', id)``; NULL id gives a NULL key that never joins."""
    return F.concat(F.lit(TELEMETRY_PREFIX), col(id_col).cast("string"))


def ever(pred: Column) -> Column:
    """``MAX(CASE WHEN pred THEN 1 ELSE 0 END)`` as INT."""
    return F.max(F.when(pred, 1).otherwise(0))


def pct(numerator, denominator, scale: int = 1) -> Column:
    """``ROUND(n * 100.0 / NULLIF(d, 0), scale)`` as DOUBLE (NULL when d = 0)."""
    n, d = col(numerator), col(denominator)
    return F.round(n.cast("double") * 100.0 / F.nullif(d, F.lit(0)).cast("double"), scale)


def ratio(numerator, denominator) -> Column:
    n, d = col(numerator), col(denominator)
    return n.cast("double") / F.nullif(d, F.lit(0)).cast("double")


def flag_sum(flags) -> Column:
    """Sum of boolean flags as INT."""
    return reduce(add, [col(f).cast("int") for f in flags])


def tier(rules, default) -> Column:
    """Ordered ``CASE WHEN``: ``rules`` is a list of (predicate, label)."""
    expr = None
    for pred, label in rules:
        expr = F.when(pred, label) if expr is None else expr.when(pred, label)
    return expr.otherwise(default) if expr is not None else F.lit(default)
