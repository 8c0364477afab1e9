"""Retention for every day, not for one reference day (KRN-05).

A use on day u makes its user active on the days u to u + w, those on which u
lies in the window of w days back. The days on which a user becomes active
(+1) and stops being so (-1) come from the distance to the user's neighbouring
uses, so that overlapping spans count once; sums of these differences, run up
over a customer's days, are its active users on every day. The window before
is the same curve w days later. Nothing is repeated per day: a use gives at
most four differences, and between changes a figure holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date
from tidemark.functions.predicates import pct

c = F.col


def active_changes(usage: DataFrame, key: str, entity: str, ts: str, window_days: int) -> DataFrame:
    """(key, day, change): by how much the number of active entities of a key
    changes on a day. Rows without entity or time count for nothing."""
    days = (usage.select(c(key).alias("_key"), c(entity).alias("_entity"), c(ts).cast("date").alias("_day"))
            .filter("_entity IS NOT NULL AND _day IS NOT NULL").distinct())
    of_entity = Window.partitionBy("_key", "_entity").orderBy("_day")
    seen = days.select("_key", "_day", F.lag("_day").over(of_entity).alias("_before"), F.lead("_day").over(of_entity).alias("_after"))
    starts = c("_before").isNull() | (F.datediff("_day", "_before") > window_days)
    ends = c("_after").isNull() | (F.datediff("_after", "_day") > window_days)
    marks = F.array(F.when(starts, F.struct(c("_day").alias("day"), F.lit(1).alias("change"))),
                    F.when(ends, F.struct(F.date_add("_day", window_days + 1).alias("day"), F.lit(-1).alias("change"))))
    return (seen.select(c("_key").alias(key), F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
            .select(key, "m.day", "m.change"))


def retention_spans(usage: DataFrame, key: str, entity: str, ts: str, window_days: int = 30) -> DataFrame:
    """(key, from_day, to_day, curr, prev, retention_pct): on each day of the
    span, ``curr`` entities were active in the window ``[day - w, day]`` and
    ``prev`` in ``[day - 2w, day - w]`` (both ends count, as in the mart). Days
    without either are left out; a row per change, whatever the days between."""
    changes = active_changes(usage, key, entity, ts, window_days)
    both = (changes.select(key, "day", c("change").alias("_c"), F.lit(0).alias("_p"))
            .unionByName(changes.select(key, F.date_add("day", window_days).alias("day"), F.lit(0).alias("_c"),
                                        c("change").alias("_p"))))
    daily = (both.groupBy(key, "day").agg(F.sum("_c").alias("_c"), F.sum("_p").alias("_p"))
             .filter((c("_c") != 0) | (c("_p") != 0)))
    by_day = Window.partitionBy(key).orderBy("day")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (daily.select(key, c("day").alias("from_day"), F.date_sub(F.lead("day").over(by_day), 1).alias("to_day"),
                         F.sum("_c").over(upto).alias("curr"), F.sum("_p").over(upto).alias("prev"))
            .filter((c("curr") > 0) | (c("prev") > 0))
            .withColumn("retention_pct", pct("curr", "prev")))


def retention_on(spans: DataFrame, day) -> DataFrame:
    """The figures of one day."""
    d = as_date(day)
    return spans.filter((c("from_day") <= d) & (c("to_day") >= d)).drop("from_day", "to_day")
