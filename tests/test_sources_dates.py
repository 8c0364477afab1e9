"""Sources from catalog tables; date dimension ranges, holidays and joins."""

import datetime as dt

from pyspark.sql import functions as F

from places import SMOKE
from tidemark.operators import date_dim as DD
from tidemark.plans import scenarios as S
from tidemark.publish.publish import dry_run
from tidemark.sources.registry import Sources
from tidemark.sources.testmap import EVENTS_AS_OF, read_table, roles


def test_sources_from_catalog_tables(spark):
    src = roles(spark, SMOKE)
    names = {}
    for role, df in src.items():
        view = f"crm_{role}"
        df.toDF(*[c.upper() for c in df.columns]).createOrReplaceTempView(view)
        names[role] = view
    from_catalog = Sources.from_tables(spark, names)
    a, b = S.scn_06(src, EVENTS_AS_OF), S.scn_06(from_catalog, EVENTS_AS_OF)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_explicit_range_date_dim(spark):
    dim = DD.date_dim(spark, "2020-01-01", dt.date(2020, 1, 1) + dt.timedelta(days=3649))
    rows = dim.agg(F.count(F.lit(1)).alias("n"), F.max("date_day").alias("last")).first()
    assert (rows.n, rows.last) == (3650, dt.date(2029, 12, 28))
    sat = dim.filter(F.col("date_day") == dt.date(2024, 1, 6)).first()   # a Saturday
    assert sat.is_weekend and sat.day_of_week == 6
    q = dim.filter(F.col("date_day") == dt.date(2024, 2, 29)).first()
    assert (q.quarter_end, q.year_end, q.prior_year_same_day, q.is_month_end) == \
        (dt.date(2024, 3, 31), dt.date(2024, 12, 31), dt.date(2023, 2, 28), True)


def test_business_days_with_holidays(spark):
    dim = DD.date_dim(spark, "2024-01-01", "2024-01-31")
    hol = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date_day date")
    b = DD.with_business_days(dim, hol)
    first = b.filter(F.col("date_day") == dt.date(2024, 1, 2)).first()
    assert first.business_day_of_month == 1
    assert b.filter("is_business_day").count() == 22   # 23 weekdays minus New Year's Day


def test_join_dim_carries_no_hint(spark):
    orders = read_table(spark, SMOKE, "orders")
    dim = DD.date_dim_for(orders, "o_orderdate")
    assert "strategy=broadcast" not in dry_run(DD.join_dim(orders, dim, "o_orderdate"), "extended")


def test_fiscal_year_by_hand(spark):
    """The year starts in April (offset 3): 1 April is the first month of the
    year's first quarter, 31 March the last of the year before."""
    dim = DD.date_dim(spark, "2024-03-31", "2024-04-01", 3)
    got = [(r.fiscal_year, r.fiscal_quarter, r.fiscal_month) for r in dim.orderBy("date_day").collect()]
    assert got == [(2023, 4, 12), (2024, 1, 1)]


def test_day_partitioned_staging_prunes_windows(spark, scratch):
    from tidemark.sources.staging import materialize_sources
    from tidemark.sources.testmap import ORDERS_AS_OF
    src = roles(spark, SMOKE)
    staged = materialize_sources(spark, src, f"{scratch}/staged", partition_by_day=True)
    for build in (lambda s: S.scn_15(s, ORDERS_AS_OF), lambda s: S.scn_14(s, ORDERS_AS_OF),
                  lambda s: S.scn_12(s, ORDERS_AS_OF), lambda s: S.scn_10(s, window_days=180)):
        a, b = build(src), build(staged)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    p = dry_run(S.scn_15(staged, ORDERS_AS_OF), "simple")
    scan = [ln for ln in p.splitlines() if "license_usage" in ln and "PartitionFilters" in ln]
    assert scan and "usage_day" in scan[0].split("PartitionFilters:")[1].split("]")[0]
    p10 = dry_run(S.scn_10(staged), "simple")
    scans = [ln for ln in p10.splitlines() if "license_usage" in ln and "PartitionFilters" in ln]
    assert any("usage_day" in ln.split("PartitionFilters:")[1].split("]")[0] for ln in scans)
    p12 = dry_run(S.scn_12(staged, ORDERS_AS_OF), "simple")
    il_scan = [ln for ln in p12.splitlines() if "il_events" in ln and "PartitionFilters" in ln]
    assert il_scan and "event_day" in il_scan[0].split("PartitionFilters:")[1].split("]")[0]
    assert S.scn_06(staged, EVENTS_AS_OF).exceptAll(S.scn_06(src, EVENTS_AS_OF)).count() == 0
