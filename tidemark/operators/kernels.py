"""Kernels the scenario marts are built from (KRN-01..08).

Every kernel aggregates a fact to the grain of the output *before* it is
joined, so joins are 1:1 on the key and a very active account (one key with a
third of all events) never fans out or lands whole in one task: aggregation
is partial on the map side, and the only things shuffled are per-task
partial rows.

Distinct counts use a two-level plan — group by (key, distinct column), then
by key — instead of Spark's ``Expand`` rewrite, which multiplies every input
row once per distinct expression before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date, parse_date


# --------------------------------------------------------------------------
# KRN-01  milestones: per-key conditional aggregates in one pass
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Spec:
    kind: str                 # ever | first | last | count | distinct
    pred: Column | None = None
    value: Column | None = None

    def _p(self) -> Column:
        return self.pred if self.pred is not None else F.lit(True)

    def direct(self, name: str) -> Column:
        p = self._p()
        if self.kind == "ever":
            return F.max(F.when(p, 1).otherwise(0)).alias(name)
        if self.kind == "first":
            return F.min(F.when(p, self.value)).alias(name)
        if self.kind == "last":
            return F.max(F.when(p, self.value)).alias(name)
        if self.kind == "count":
            if self.value is None:
                return F.count(F.when(p, 1)).alias(name)
            return F.coalesce(F.sum(F.when(p, self.value)), F.lit(0)).cast("long").alias(name)
        raise ValueError(f"{self.kind} needs a distinct column")

    def partial(self, name: str) -> Column:
        if self.kind == "distinct":
            return F.max(F.when(self._p(), 1).otherwise(0)).alias(name)
        return self.direct(name)

    def final(self, name: str, distinct_col: str) -> Column:
        c = F.col(name)
        if self.kind in ("ever", "last"):
            return F.max(c).alias(name)
        if self.kind == "first":
            return F.min(c).alias(name)
        if self.kind == "count":
            return F.sum(c).alias(name)
        # COUNT(DISTINCT CASE WHEN p THEN x END): NULL x is not counted.
        return F.count(F.when((c == 1) & F.col(distinct_col).isNotNull(), 1)).alias(name)


def ever(pred: Column) -> Spec:
    return Spec("ever", pred)


def first(pred: Column | None, value: Column) -> Spec:
    return Spec("first", pred, value)


def last(pred: Column | None, value: Column) -> Spec:
    return Spec("last", pred, value)


def count_if(pred: Column | None = None, weight: Column | None = None) -> Spec:
    """Rows that match, or the sum of their ``weight`` (rows that stand for
    several events)."""
    return Spec("count", pred, weight)


def distinct(pred: Column | None = None) -> Spec:
    return Spec("distinct", pred)


def milestones(events: DataFrame, key: str, specs: dict[str, Spec],
               distinct_col: str | None = None) -> DataFrame:
    """One row per ``key`` with one column per spec.

    ``distinct`` specs count distinct values of ``distinct_col`` among rows
    matching their predicate; all other specs are mergeable, so the plan is
    ``groupBy(key, distinct_col)`` → ``groupBy(key)`` with no ``Expand``.
    """
    if not any(s.kind == "distinct" for s in specs.values()):
        return events.groupBy(key).agg(*[s.direct(n) for n, s in specs.items()])
    if distinct_col is None:
        raise ValueError("distinct specs need distinct_col")
    return milestone_totals(milestone_parts(events, key, specs, distinct_col), key, specs, distinct_col)


def milestone_parts(events: DataFrame, key: str, specs: dict[str, Spec], distinct_col: str) -> DataFrame:
    """First level of ``milestones``: a row per key and value of the distinct
    column. Such rows of several batches merge measure by measure."""
    return events.groupBy(key, distinct_col).agg(*[s.partial(n) for n, s in specs.items()])


def milestone_totals(parts: DataFrame, key: str, specs: dict[str, Spec], distinct_col: str) -> DataFrame:
    """Second level of ``milestones``: a row per key."""
    return parts.groupBy(key).agg(*[s.final(n, distinct_col) for n, s in specs.items()])


def event_date(time_col: str = "event_time") -> Column:
    """Parsed day of a free-text event time (junk → NULL)."""
    return parse_date(F.col(time_col))


def named(name: str, name_col: str = "tracked_event_name") -> Column:
    return F.col(name_col) == F.lit(name)


# --------------------------------------------------------------------------
# KRN-02  never_did: anti join against the keys that did something
# --------------------------------------------------------------------------

def keys_that(events: DataFrame, key: str, pred: Column | None = None,
              name_col: str | None = "tracked_event_name") -> DataFrame:
    """Distinct keys with at least one matching event.

    ``COUNT(col)`` ignores NULL, so rows with a NULL event name never count.
    The ``distinct`` is partial on the map side: a hot key is reduced to one
    row per task before the shuffle.
    """
    ev = events
    if name_col is not None:
        ev = ev.filter(F.col(name_col).isNotNull())
    if pred is not None:
        ev = ev.filter(pred)
    return ev.select(key).distinct()


def never_did(base: DataFrame, base_key: str, events: DataFrame, key: str,
              pred: Column | None = None, name_col: str | None = "tracked_event_name") -> DataFrame:
    """Rows of ``base`` whose key has no matching event (``left_anti``)."""
    did = keys_that(events, key, pred, name_col).withColumnRenamed(key, "__did_key")
    return base.join(did, F.col(base_key) == F.col("__did_key"), "left_anti")


# --------------------------------------------------------------------------
# KRN-03  started_not_completed
# --------------------------------------------------------------------------

def started_not_completed(events: DataFrame, key: str, started: Column, completed: Column,
                          day: Column, as_of=None, min_age_days: int | None = None,
                          extra: dict[str, Spec] | None = None, distinct_col: str | None = None,
                          weight: Column | None = None) -> DataFrame:
    """Keys with a ``started`` and without a ``completed`` event. Columns: key,
    first_start, last_start, starts, completed (0), the ``extra`` specs, and
    with ``min_age_days`` also days_since_first_start, which must exceed it.
    ``weight`` is the number of events a row stands for (a rollup's rows)."""
    if extra is None:  # only these rows matter then
        events = events.filter(started | completed)
    m = milestones(events, key, {
        "first_start": first(started, day),
        "last_start": last(started, day),
        "starts": count_if(started, weight),
        "completed": ever(completed),
        **(extra or {}),
    }, distinct_col)
    m = m.filter((F.col("starts") > 0) & (F.col("completed") == 0))
    if min_age_days is None:
        return m
    m = m.withColumn("days_since_first_start", F.datediff(as_date(as_of), F.col("first_start")))
    return m.filter(F.col("days_since_first_start") > min_age_days)


# --------------------------------------------------------------------------
# KRN-04  active_rollup
# --------------------------------------------------------------------------

def active_rollup(usage: DataFrame, key: str, ts: str, entity: str | None = None,
                  windows: dict[str, Column] | None = None, last_ts: str | None = None) -> DataFrame:
    """Per key: first_use, last_use and, without ``entity``, active_days; with
    it ``entities`` (distinct ones) and per window the distinct entities that
    match its predicate. ``last_ts`` names the latest time of a row that stands
    for several (``usage_days``); ``ts`` is its earliest."""
    hi = last_ts or ts
    if entity is None:
        return usage.groupBy(key).agg(
            F.min(ts).alias("first_use"),
            F.max(hi).alias("last_use"),
            F.count_distinct(F.col(ts).cast("date")).alias("active_days"))
    flags = windows or {}
    per = usage.groupBy(key, entity).agg(
        F.min(ts).alias("first_use"), F.max(hi).alias("last_use"),
        *[F.max(F.when(p, 1).otherwise(0)).alias(n) for n, p in flags.items()])
    known = F.col(entity).isNotNull()
    return per.groupBy(key).agg(
        F.min("first_use").alias("first_use"), F.max("last_use").alias("last_use"),
        F.count(F.when(known, 1)).alias("entities"),
        *[F.count(F.when((F.col(n) == 1) & known, 1)).alias(n) for n in flags])


def usage_days(usage: DataFrame, key: str = "customerid", entity: str = "assigneduser",
               ts: str = "lastvalidateddate") -> DataFrame:
    """Usage reduced to one row per (key, entity, day): ``ts`` is the earliest
    time of the day and ``last_ts`` the latest. All that the scenarios ask of
    the usage log can be answered from it."""
    return (usage.groupBy(key, entity, F.col(ts).cast("date").alias("usage_day"))
            .agg(F.min(ts).alias(ts), F.max(ts).alias("last_ts")))


def distinct_entities(usage: DataFrame, key: str, entity: str, flags: dict[str, Column]) -> DataFrame:
    """``COUNT(DISTINCT CASE WHEN flag THEN entity END)`` for several flags,
    as ``groupBy(key, entity)`` → ``groupBy(key)``."""
    level1 = usage.groupBy(key, entity).agg(
        *[F.max(F.when(p, 1).otherwise(0)).alias(n) for n, p in flags.items()])
    valid = F.col(entity).isNotNull()
    return level1.groupBy(key).agg(
        *[F.count(F.when((F.col(n) == 1) & valid, 1)).alias(n) for n in flags])


# --------------------------------------------------------------------------
# KRN-05  window_retention: current vs previous window of distinct users
# --------------------------------------------------------------------------

def window_retention(usage: DataFrame, key: str, entity: str, ts: str, ref,
                     window_days: int = 30, exclusive: bool = False) -> DataFrame:
    """Distinct entities active in ``[ref - w, ..]`` (current) and in
    ``[ref - 2w, ref - w]`` (previous). Both bounds are inclusive, so an
    event exactly at midnight of ``ref - w`` counts in both windows (as in the
    source); ``exclusive=True`` makes the previous window end before it."""
    r = as_date(ref) if not isinstance(ref, Column) else ref
    t = F.col(ts)
    lo, hi = F.date_sub(r, 2 * window_days), F.date_sub(r, window_days)
    # A row that stands for a day's rows (``usage_days``) begins at ``ts``.
    end = F.col("last_ts") if "last_ts" in usage.columns else t
    recent = usage.filter(end >= lo)
    return distinct_entities(recent, key, entity, {
        "curr": end >= hi,
        "prev": (end >= lo) & (t < hi if exclusive else t <= hi),
    })


# --------------------------------------------------------------------------
# KRN-06  dormancy: registered seats and seats idle for N days
# --------------------------------------------------------------------------

def dormancy(keys: DataFrame, key: str | list[str], entity: str, last_used: str, as_of,
             idle_days: int = 30) -> DataFrame:
    """Per key: ``total`` distinct entities and ``dormant`` entities having a
    key never used or last used before ``as_of - idle_days``."""
    lu = F.col(last_used)
    dormant = lu.isNull() | (lu < F.date_sub(as_date(as_of), idle_days))
    ks = [key] if isinstance(key, str) else list(key)
    level1 = keys.groupBy(*ks, entity).agg(F.max(F.when(dormant, 1).otherwise(0)).alias("_d"))
    valid = F.col(entity).isNotNull()
    return level1.groupBy(*ks).agg(
        F.count(F.when(valid, 1)).alias("total"),
        F.count(F.when(valid & (F.col("_d") == 1), 1)).alias("dormant"),
    )


# --------------------------------------------------------------------------
# As-of lookups per key without pairing rows
# --------------------------------------------------------------------------

def running_by_day(facts: DataFrame, probes: DataFrame, key: str, day: str,
                   sums: list[str] = (), maxes: list[str] = ()) -> DataFrame:
    """For every probe (key, day): the sum / max of fact measures over all
    fact days ≤ the probe day, per key.

    ``facts`` must already be reduced to one row per (key, day). Facts and
    probes are merged per (key, day) and a running window over each key's
    days answers every probe; the result is joined back to the probes by
    equality. A window partition holds the key's distinct days, never its
    raw rows, and no probe is paired with any fact row.
    """
    f = facts.select(key, day, *sums, *maxes)
    p = probes.select(key, day).distinct()
    for m in list(sums) + list(maxes):
        p = p.withColumn(m, F.lit(None).cast(f.schema[m].dataType))
    merged = f.unionByName(p).groupBy(key, day).agg(
        *[F.sum(m).alias(m) for m in sums], *[F.max(m).alias(m) for m in maxes])
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = merged.select(key, day, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(m) for m in sums],
                        *[F.max(m).over(w).alias(m) for m in maxes])
    return run.join(probes.select(key, day).distinct(), [key, day], "left_semi")
