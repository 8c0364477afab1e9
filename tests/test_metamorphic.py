"""Metamorphic properties: row order, partitioning and duplicated events do
not change ever-flags; shifting every date and as_of keeps membership."""

import datetime as dt

from pyspark.sql import functions as F

from places import SMOKE
from tidemark.plans import scenarios as S
from tidemark.sources.testmap import EVENTS_AS_OF, roles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicates_and_repartition_keep_flags(spark):
    src = roles(spark, SMOKE)
    base = rows(S.scn_08(src).drop("total_il_sessions"))
    noisy = src.il_events.unionByName(src.il_events).repartition(7, "session_id").orderBy(F.rand(3))
    assert rows(S.scn_08(src.with_(il_events=noisy)).drop("total_il_sessions")) == base


def test_shifting_dates_keeps_membership(spark):
    src = roles(spark, SMOKE)
    k = 400

    def shift(df):
        t = F.try_to_timestamp(F.col("event_time"))
        return df.withColumn("event_time", F.when(t.isNull(), F.col("event_time"))
                             .otherwise(F.date_format(t + F.expr(f"INTERVAL {k} DAYS"), "yyyy-MM-dd HH:mm:ss")))

    moved = src.with_(rc_events=shift(src.rc_events), il_events=shift(src.il_events))
    later = EVENTS_AS_OF + dt.timedelta(days=k)
    a = rows(S.scn_06(src, EVENTS_AS_OF).select("telemetry_account_id", "schedule_page_visits"))
    b = rows(S.scn_06(moved, later).select("telemetry_account_id", "schedule_page_visits"))
    assert a == b
    for build in (lambda s, d: S.scn_09(s, d), lambda s, d: S.scn_13(s, d, 20, 14)):
        ids = lambda df: sorted(r[0] for r in df.select("telemetry_account_id").collect())
        assert ids(build(src, EVENTS_AS_OF)) == ids(build(moved, later))
