"""Date dimension (DIM-01..04).

One row per calendar day with calendar, fiscal, period-boundary and
prior-period columns. The day range is either explicit or derived from a
fact's own date column (so the dimension always covers the data). The
dimension has one row per day of the range — its size is bounded by the
span in days, not by data volume — which is what makes broadcasting it
safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter_end, year_end

c = F.col


def _columns(d: Column, fiscal_offset_months: int) -> list[Column]:
    # A year that starts n months into the calendar year lies n months back.
    fd = F.add_months(d, -fiscal_offset_months) if fiscal_offset_months else d
    month_end = F.last_day(d)
    q_end, y_end = quarter_end(d), year_end(d)
    return [
        d.alias("date_day"),
        F.year(d).alias("calendar_year"),
        F.quarter(d).alias("calendar_quarter"),
        F.month(d).alias("calendar_month"),
        F.dayofmonth(d).alias("calendar_day_of_month"),
        (F.dayofweek(d) - 1).alias("day_of_week"),          # 0 = Sunday … 6 = Saturday
        F.dayofyear(d).alias("day_of_year"),
        F.trunc(d, "month").alias("month_start"),
        month_end.alias("month_end"),
        F.trunc(d, "quarter").alias("quarter_start"),
        q_end.alias("quarter_end"),
        F.trunc(d, "year").alias("year_start"),
        y_end.alias("year_end"),
        F.add_months(d, -12).alias("prior_year_same_day"),
        F.last_day(F.add_months(d, -12)).alias("prior_year_month_end"),
        F.year(fd).alias("fiscal_year"),
        F.quarter(fd).alias("fiscal_quarter"),
        F.month(fd).alias("fiscal_month"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),      # Sunday, Saturday
        (d == month_end).alias("is_month_end"),
        (d == q_end).alias("is_quarter_end"),
        (d == y_end).alias("is_year_end"),
    ]


def date_dim(spark: SparkSession, start, end, fiscal_offset_months: int = 0) -> DataFrame:
    """Days ``start..end`` inclusive, generated with ``spark.range`` (no gaps)."""
    import datetime as dt
    s = start if isinstance(start, dt.date) else dt.date.fromisoformat(str(start))
    e = end if isinstance(end, dt.date) else dt.date.fromisoformat(str(end))
    n = (e - s).days + 1
    days = spark.range(n).select(F.date_add(F.lit(s), c("id").cast("int")).alias("d"))
    return days.select(*_columns(c("d"), fiscal_offset_months))


def date_dim_for(df: DataFrame, date_col: str, fiscal_offset_months: int = 0,
                 pad_days: int = 0) -> DataFrame:
    """Date dimension spanning ``min..max`` of ``date_col`` in ``df``.

    The bounds come from one aggregate (partial on every task); the days are
    then generated from that single row with ``sequence`` — span-bounded.
    """
    d = c(date_col).cast("date")
    bounds = df.agg(F.date_sub(F.min(d), pad_days).alias("lo"), F.date_add(F.max(d), pad_days).alias("hi"))
    days = bounds.select(F.explode(F.sequence(c("lo"), c("hi"))).alias("d"))
    return days.select(*_columns(c("d"), fiscal_offset_months))


def with_business_days(dim: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """DIM-03: ``is_holiday``, ``is_business_day`` and the running business-day
    number within each month (window partitioned by month: ≤ 31 rows each)."""
    if holidays is not None:
        h = holidays.select(c("date_day").alias("_h")).distinct()
        dim = dim.join(h, c("date_day") == c("_h"), "left") \
            .withColumn("is_holiday", c("_h").isNotNull()).drop("_h")
    else:
        dim = dim.withColumn("is_holiday", F.lit(False))
    dim = dim.withColumn("is_business_day", ~c("is_weekend") & ~c("is_holiday"))
    w = Window.partitionBy("month_start").orderBy("date_day") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dim.withColumn("business_day_of_month",
                          F.sum(c("is_business_day").cast("int")).over(w))


def with_business_index(dim: DataFrame) -> DataFrame:
    """DIM-03: ``business_index``, the business days of the whole dimension up
    to and including the day (a weekend or holiday has that of the business day
    before), for a dimension ``with_business_days``. Days are counted inside
    their month; only the months' totals, a row each, are summed up in order."""
    before = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, -1)
    months = (dim.groupBy("month_start").agg(F.max("business_day_of_month").alias("_in_month"))
              .select(c("month_start").alias("_m"), F.coalesce(F.sum("_in_month").over(before), F.lit(0)).alias("_before")))
    return (dim.join(months, c("month_start") == c("_m"))
            .withColumn("business_index", c("_before") + c("business_day_of_month")).drop("_m", "_before"))


def business_days_after(fact: DataFrame, date_col: str, n: int, dim: DataFrame, into: str = "due_day") -> DataFrame:
    """The day ``n`` business days after a date (before it, if negative): two
    equality lookups in a dimension ``with_business_index``. A date that is no
    business day counts from the one before; with ``n`` = 0 it is that one.
    NULL where the dimension does not reach."""
    start = dim.select(c("date_day").alias("_d"), (c("business_index") + n).alias("_i"))
    goal = dim.filter("is_business_day").select(c("business_index").alias("_g"), c("date_day").alias(into))
    return (fact.join(start, c(date_col).cast("date") == c("_d"), "left")
            .join(goal, c("_i") == c("_g"), "left").drop("_d", "_i", "_g"))


def business_days_between(fact: DataFrame, start_col: str, end_col: str, dim: DataFrame,
                          into: str = "business_days") -> DataFrame:
    """Business days after ``start_col`` up to and including ``end_col``
    (negative if it comes first), by two equality lookups."""
    def at(mark: str) -> DataFrame:
        return dim.select(c("date_day").alias(f"_{mark}d"), c("business_index").alias(f"_{mark}i"))

    return (fact.join(at("s"), c(start_col).cast("date") == c("_sd"), "left")
            .join(at("e"), c(end_col).cast("date") == c("_ed"), "left")
            .withColumn(into, c("_ei") - c("_si")).drop("_sd", "_si", "_ed", "_ei"))


def join_dim(fact: DataFrame, dim: DataFrame, fact_date: str) -> DataFrame:
    """JN-11: attach date attributes to a fact. Spark broadcasts the dimension
    if its measured size allows."""
    return fact.join(dim, c(fact_date).cast("date") == c("date_day"), "left")


def prior_year_days(fact: DataFrame, date_col: str, measure: Column, dim: DataFrame) -> DataFrame:
    """DIM-04: per day, a measure and the same measure on the same day of the
    year before (29 February looks at the 28th)."""
    daily = fact.groupBy(c(date_col).cast("date").alias("date_day")).agg(measure.alias("value"))
    prior = daily.select(c("date_day").alias("_pd"), c("value").alias("prior_year_value"))
    return (dim.select("date_day", "prior_year_same_day").join(daily, "date_day", "left")
            .join(prior, c("prior_year_same_day") == c("_pd"), "left")
            .select("date_day", "prior_year_same_day", "value", "prior_year_value"))


def prior_year_compare(fact: DataFrame, date_col: str, measure: Column, dim: DataFrame) -> DataFrame:
    """DIM-04: per month end, a measure and the same measure one year earlier,
    looked up through ``prior_year_month_end`` of the date dimension."""
    monthly = (fact.groupBy(F.last_day(c(date_col).cast("date")).alias("month_end"))
               .agg(measure.alias("value")))
    months = dim.filter(c("is_month_end")).select("month_end", "prior_year_month_end")
    prior = monthly.select(c("month_end").alias("_pm"), c("value").alias("prior_year_value"))
    return (months.join(monthly, "month_end", "left")
            .join(prior, c("prior_year_month_end") == c("_pm"), "left")
            .select("month_end", "prior_year_month_end", "value", "prior_year_value",
                    F.round((c("value") - c("prior_year_value")) * 100.0
                            / F.nullif(c("prior_year_value"), F.lit(0)), 1).alias("yoy_pct")))

