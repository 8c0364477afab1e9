"""Documented concept examples (CPT-01..04): ARR snapshots and retention.

Input is a daily ARR snapshot fact: (account_id, snapshot_date, snapshot_id,
arr, customer_type). Every window here is partitioned by account and runs
over data already reduced to one row per account and month, so a partition
holds at most one row per month of history — bounded by the time span, not
by data volume. Money is DECIMAL(18, 2), so sums are exact and the same in
whichever order rows come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import pct

c = F.col

MONEY = "decimal(18,2)"
EXCLUDED_CUSTOMER_TYPES = ("Test", "Internal")


def month_end_snapshot(arr_daily: DataFrame, excluded=EXCLUDED_CUSTOMER_TYPES) -> DataFrame:
    """CPT-01: the last snapshot of each account in each month.
    (account_id, month_end, snapshot_date, arr)."""
    d = arr_daily.filter(~c("customer_type").isin(*excluded) | c("customer_type").isNull())
    d = d.withColumn("month_end", F.last_day("snapshot_date"))
    w = Window.partitionBy("account_id", "month_end").orderBy(c("snapshot_date").desc(),
                                                              c("snapshot_id").desc())
    return (d.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") == 1)
            .select("account_id", "month_end", "snapshot_date", c("arr").cast(MONEY).alias("arr")))


def arr_by_account_month(arr_daily: DataFrame, date_dim: DataFrame) -> DataFrame:
    """CPT-02: one row per (account, month): starting ARR (previous calendar
    month's ending, 0 if none), ending ARR, and the fiscal period of the
    month end (date dimension lookup)."""
    m = month_end_snapshot(arr_daily)
    w = Window.partitionBy("account_id").orderBy("month_end")
    prev_end, prev_arr = F.lag("month_end").over(w), F.lag("arr").over(w)
    m = m.select("account_id", "month_end", c("arr").alias("ending_arr"),
                 F.when(prev_end == F.last_day(F.add_months(c("month_end"), -1)), prev_arr)
                 .otherwise(F.lit(0).cast(MONEY)).alias("starting_arr"))
    fiscal = date_dim.filter(c("is_month_end")).select(c("date_day").alias("_d"), "fiscal_year",
                                                       "fiscal_quarter", "fiscal_month")
    return (m.join(fiscal, c("month_end") == c("_d"), "left")
            .select("account_id", "month_end", "fiscal_year", "fiscal_quarter", "fiscal_month",
                    "starting_arr", "ending_arr"))


def gross_retention(by_month: DataFrame) -> DataFrame:
    """CPT-03: per month, gross retention of the ARR cohort (accounts with
    starting ARR > 0): Σ min(ending, starting) / Σ starting, in percent."""
    cohort = by_month.filter(c("starting_arr") > 0)
    return (cohort.groupBy("month_end")
            .agg(F.count(F.lit(1)).alias("cohort_accounts"),
                 F.sum("starting_arr").alias("arr_cohort"),
                 F.sum(F.least("ending_arr", "starting_arr")).alias("retained_arr"))
            .withColumn("gross_retention_pct", pct("retained_arr", "arr_cohort")))


def active_at_month_end(activity: DataFrame, key: str, date_col: str) -> DataFrame:
    """CPT-04: accounts active at each month end, where active means the
    month end lies within the account's first..last activity. Each account
    expands to the month ends of its own span (no cross join with a calendar)."""
    span = activity.groupBy(key).agg(F.min(c(date_col).cast("date")).alias("_first"),
                                     F.max(c(date_col).cast("date")).alias("_last"))
    months = span.select(key, "_last", F.explode(
        F.sequence(F.trunc("_first", "month"), F.trunc("_last", "month"),
                   F.expr("INTERVAL 1 MONTH"))).alias("m"))
    months = months.select(key, "_last", F.last_day("m").alias("month_end"))
    # A key has each month once, so rows count keys.
    active = months.filter((c("month_end") <= c("_last")) & c(key).isNotNull())
    return active.groupBy("month_end").agg(F.count(F.lit(1)).alias("active_accounts"))
