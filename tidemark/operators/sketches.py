"""Mergeable sketches kept per day (QLT-08 quantiles and outliers, PRF-03
distinct counts).

A day's sketch is computed from that day's rows alone and stored under its
day; any period is the union of its days' sketches. So a new or restaged day
costs one day, and a period reads a few rows per day instead of the fact.
Quantiles are KLL sketches (rank error below RANK_ERROR of the period's rows),
distinct counts HLL sketches (standard error DISTINCT_ERROR); both are
aggregates of Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date

c = F.col
# Size of a KLL sketch and its rank error (with 99 % confidence); log2 of the
# registers of an HLL sketch and its standard error.
K, RANK_ERROR = 1_600, 0.005
LG_K, DISTINCT_ERROR = 14, 1.04 / 2 ** 7


def _store(days: DataFrame, path: str) -> None:
    """Replace the days of ``days`` in the store and no others."""
    (days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def _of_days(df: DataFrame, day_col: str, days: Sequence | None) -> DataFrame:
    own = df if days is None else df.filter(c(day_col).cast("date").isin([*days]))
    return own.withColumn("day", c(day_col).cast("date")).filter("day IS NOT NULL")


def _period(spark: SparkSession, path: str, start, end) -> DataFrame:
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.filter(c("day") >= as_date(start))
    return rows if end is None else rows.filter(c("day") <= as_date(end))


# ------------------------------------------------------------------ quantiles

def store_quantiles(df: DataFrame, path: str, day_col: str, measures: list[str], days: Sequence | None = None) -> None:
    """Sketches of ``measures`` for every day of ``df``, or for ``days`` only
    (new or restaged ones): (day, measure, rows, sketch)."""
    own = _of_days(df, day_col, days)
    aggs = [a for m in measures for a in (F.count(m).alias(f"n_{m}"),
                                          F.expr(f"kll_sketch_agg_double(CAST(`{m}` AS DOUBLE), {K})").alias(f"s_{m}"))]
    body = ", ".join(f"'{m}', `n_{m}`, `s_{m}`" for m in measures)
    _store(own.groupBy("day").agg(*aggs)
           .selectExpr("day", f"stack({len(measures)}, {body}) AS (measure, rows, sketch)").filter("rows > 0"), path)


def quantiles(spark: SparkSession, path: str, qs: Sequence[float], start=None, end=None,
              period: str | None = None) -> DataFrame:
    """(period, measure, rows, quantile, value) over the days from ``start``
    to ``end``; ``period`` is an expression of ``day`` (``year(day)``) that
    splits them."""
    merged = (_period(spark, path, start, end).withColumn("period", F.expr(period or "'all'"))
              .groupBy("period", "measure")
              .agg(F.sum("rows").alias("rows"), F.expr("kll_merge_agg_double(sketch)").alias("sketch")))
    body = ", ".join(f"{q}D, kll_sketch_get_quantile_double(sketch, {q}D)" for q in qs)
    return merged.selectExpr("period", "measure", "rows", f"stack({len(qs)}, {body}) AS (quantile, value)")


def fences(spark: SparkSession, path: str, measure: str, start=None, end=None, reach: float = 1.5) -> DataFrame:
    """One row (lo, hi): the quartiles of the period moved outwards by
    ``reach`` times their distance."""
    wide = (quantiles(spark, path, (0.25, 0.75), start, end).filter(c("measure") == measure)
            .agg(F.max(F.when(c("quantile") == 0.25, c("value"))).alias("q1"),
                 F.max(F.when(c("quantile") == 0.75, c("value"))).alias("q3")))
    gap = reach * (c("q3") - c("q1"))
    return wide.select((c("q1") - gap).alias("lo"), (c("q3") + gap).alias("hi"))


def outliers(df: DataFrame, path: str, day_col: str, measure: str, start, end, reach: float = 1.5) -> DataFrame:
    """Rows of the period whose measure lies outside the stored ``fences``;
    the fences come as scalars, so the fact is filtered and not joined."""
    f = fences(df.sparkSession, path, measure, start, end, reach)
    lo, hi = f.select("lo").scalar(), f.select("hi").scalar()
    own = df.filter((c(day_col) >= as_date(start)) & (c(day_col) < F.date_add(as_date(end), 1)))
    return own.filter((c(measure) < lo) | (c(measure) > hi))


# ------------------------------------------------------------ column profiles

def store_profile(df: DataFrame, path: str, day_col: str, days: Sequence | None = None) -> None:
    """PRF-03: per day and column (day, column_name, data_type, rows, nulls,
    sketch of the distinct values), for every day of ``df`` or ``days`` only."""
    own, fields = _of_days(df, day_col, days), [f for f in df.schema.fields if f.name != "day"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for f in fields:
        aggs += [F.count_if(c(f"`{f.name}`").isNull()).alias(f"nulls_{f.name}"),
                 F.hll_sketch_agg(c(f"`{f.name}`").cast("string"), F.lit(LG_K)).alias(f"s_{f.name}")]
    body = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', `nulls_{f.name}`, `s_{f.name}`" for f in fields)
    _store(own.groupBy("day").agg(*aggs)
           .selectExpr("day", "rows", f"stack({len(fields)}, {body}) AS (column_name, data_type, nulls, sketch)"), path)


def stored_profile(spark: SparkSession, path: str, table: str, start=None, end=None) -> DataFrame:
    """The columns of ``profile.column_profile`` for a period, from the store;
    distinct counts are within a few DISTINCT_ERROR."""
    return (_period(spark, path, start, end).groupBy("column_name", "data_type")
            .agg(F.sum("rows").alias("row_count"), F.sum("nulls").alias("null_count"),
                 F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))
            .select(F.lit(table).alias("table_name"), "row_count", "column_name", "data_type", "null_count",
                    "distinct_count"))
