"""Sketches kept per day, and business-day arithmetic."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from places import SF001
from tidemark.operators import date_dim as DD, profile as P, sketches as SK
from tidemark.publish.publish import dry_run
from tidemark.sources.testmap import read_table


def test_quantiles_of_any_period_within_the_bound(spark, scratch):
    orders = read_table(spark, SF001, "orders").withColumn("neg", -F.col("o_totalprice"))
    SK.store_quantiles(orders, f"{scratch}/q", "o_orderdate", ["o_totalprice", "neg"])
    for start, end in (("1996-02-03", "1996-02-20"), ("1995-01-01", "2001-12-31")):
        own = orders.filter(F.col("o_orderdate").cast("date").between(start, end)).select("o_totalprice", "neg").toPandas()
        got = SK.quantiles(spark, f"{scratch}/q", (0.01, 0.5, 0.99), start, end).collect()
        assert len(got) == 6 and {r.rows for r in got} == {len(own)}
        for r in got:
            x = own[r.measure]
            slack = SK.RANK_ERROR * len(x) + 1
            assert (x < r.value).sum() - slack <= r.quantile * len(x) <= (x <= r.value).sum() + slack
    scan = [ln for ln in dry_run(SK.quantiles(spark, f"{scratch}/q", (0.5,), "1996-02-03", "1996-02-20")).splitlines()
            if "PartitionFilters" in ln]
    assert scan and "day" in scan[0]


def test_outliers_of_a_period(spark, scratch):
    rows = [(dt.datetime(2024, 1, 1 + k % 9, 5), float(k % 100)) for k in range(900)]
    rows += [(dt.datetime(2024, 1, 5), 1e6), (dt.datetime(2024, 1, 5), -1e6), (dt.datetime(2024, 2, 1), 5e6),
             (dt.datetime(2024, 1, 5), None), (None, 7e6)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    SK.store_quantiles(df, f"{scratch}/q", "ts", ["v"])
    got = SK.outliers(df, f"{scratch}/q", "ts", "v", "2024-01-01", "2024-01-09")
    assert sorted(r.v for r in got.collect()) == [-1e6, 1e6]
    assert "CartesianProduct" not in dry_run(got) and "NestedLoop" not in dry_run(got)


def test_a_new_day_costs_one_day(spark, scratch):
    events = read_table(spark, SF001, "events")
    SK.store_profile(events.filter("ts < '2024-01-20'"), f"{scratch}/p", "ts")
    old = {f: os.path.getmtime(f) for f in glob.glob(f"{scratch}/p/day=*/*.parquet")}
    for day in sorted(r.d for r in events.select(F.to_date("ts").alias("d")).distinct().collect()):
        if day >= dt.date(2024, 1, 20):
            SK.store_profile(events, f"{scratch}/p", "ts", [day])
    assert all(os.path.getmtime(f) == t for f, t in old.items())
    SK.store_profile(events, f"{scratch}/whole", "ts")
    key = lambda p: sorted(map(tuple, SK.stored_profile(spark, p, "events").collect()))
    assert key(f"{scratch}/p") == key(f"{scratch}/whole")
    # The union of the days is what one pass over the table gives (which is
    # united with itself, as a union estimates otherwise than a single sketch).
    once = events.select([F.hll_sketch_agg(F.col(n).cast("string"), F.lit(SK.LG_K)).alias(n) for n in events.columns])
    once = once.unionByName(once).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in events.columns]).first()
    exact = {r.column_name: r for r in P.column_profile(events, "events", exact=True).collect()}
    for r in SK.stored_profile(spark, f"{scratch}/p", "events").collect():
        e = exact[r.column_name]
        assert (r.row_count, r.null_count, r.data_type) == (e.row_count, e.null_count, e.data_type)
        assert r.distinct_count == once[r.column_name]
        assert abs(r.distinct_count - e.distinct_count) <= 4 * SK.DISTINCT_ERROR * e.distinct_count + 1


@pytest.fixture(scope="module")
def dim(spark):
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 15),), (dt.date(2024, 1, 15),)], "date_day date")
    return DD.with_business_index(DD.with_business_days(DD.date_dim(spark, "2023-12-01", "2024-03-31"), holidays))


def plain_after(day, n, off):
    step = 1 if n > 0 else -1
    while day.weekday() > 4 or day in off:
        day -= dt.timedelta(1)
    while n:
        day += dt.timedelta(step)
        if day.weekday() < 5 and day not in off:
            n -= step
    return day


@pytest.mark.parametrize("n", [0, 1, 5, 17, -1, -4])
def test_business_days_after_as_counted(spark, dim, n):
    off = {dt.date(2024, 1, 1), dt.date(2024, 1, 15)}
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(50)]
    fact = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r.d: r.due_day for r in DD.business_days_after(fact, "d", n, dim).collect()}
    assert got == {d: plain_after(d, n, off) for d in days}
    if n >= 0:
        both = DD.business_days_between(DD.business_days_after(fact, "d", n, dim), "d", "due_day", dim)
        assert {r.business_days for r in both.collect()} == {n}


def test_beyond_the_dimension_is_null(spark, dim):
    fact = spark.createDataFrame([(dt.date(2024, 3, 29),), (dt.date(2030, 1, 1),), (None,)], "d date")
    assert [r.due_day for r in DD.business_days_after(fact, "d", 3, dim).collect()] == [None] * 3
