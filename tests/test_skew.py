"""Hot keys: one account holds a third of all events. Results must stay whole
and exact (checked against a brute-force pandas computation), and the
aggregations must be partial before the shuffle so the hot key never
reaches one task as raw rows."""

import datetime as dt

from pyspark.sql import functions as F

from places import SMOKE
from tidemark.functions import vocabulary as V
from tidemark.plans import scenarios as S
from tidemark.publish.publish import dry_run
from tidemark.sources.testmap import roles

LATE = dt.date(2024, 6, 30)   # every account is idle by then


def _skewed_il(src):
    """Every IL row again under one account (with its own sessions): the hot
    account then holds half of all rows."""
    il = src.il_events
    hot = (il.withColumn("account_id", F.lit("platform:hot"))
           .withColumn("session_id", F.concat(F.lit("h"), F.col("session_id"))))
    return il.unionByName(hot)


def test_hot_account_exact_s8_s13(spark):
    src = roles(spark, SMOKE)
    il = _skewed_il(src)
    skewed = src.with_(il_events=il.repartition(4))
    pdf = il.toPandas()

    got8 = {r.telemetry_account_id: (r.visited_il_home, r.saved_rule, r.total_il_sessions)
            for r in S.scn_08(skewed).collect()}
    g = pdf.groupby("account_id", dropna=False)
    want8 = {}
    for acct, grp in g:
        home = int((grp.tracked_event_name == V.IL_HOME).any())
        saved = int((grp.tracked_event_name == V.IL_SAVE_RULE).any())
        if home == 1 and saved == 0:
            want8[acct] = (home, saved, grp.session_id.dropna().nunique())
    assert got8 == want8

    got13 = {r.telemetry_account_id: (r.total_rules_saved, r.rules_deleted)
             for r in S.scn_13(skewed, LATE).collect()}
    assert "platform:hot" in got13
    for acct, (saved, deleted) in got13.items():
        grp = pdf[pdf.account_id == acct]
        assert saved == grp[grp.tracked_event_name == V.IL_SAVE_RULE].session_id.dropna().nunique()
        assert deleted == grp[grp.tracked_event_name == V.IL_DELETE_RULE].session_id.dropna().nunique()


def test_aggregation_is_partial_before_shuffle(spark):
    src = roles(spark, SMOKE)
    p = dry_run(S.scn_08(src.with_(il_events=_skewed_il(src))), "simple")
    lines = p.splitlines()
    first_exchange = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    # a partial aggregate sits under (after, in tree order) the first shuffle
    assert any("HashAggregate" in ln and "partial_" in ln for ln in lines[first_exchange:])
