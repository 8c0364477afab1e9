"""Milestone state per account, the pruned rollup and restaging."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from places import SMOKE
from tidemark.plans import telemetry as TL
from tidemark.publish.publish import dry_run
from tidemark.publish.versions import latest
from tidemark.sources.schemas import SOURCE_SCHEMAS
from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, roles
from tidemark.streaming import rollup as R, state as ST

EVENTS = "account_id string, tracked_event_name string, event_time string, session_id string"


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def batch_of(df, k, n=4):
    return df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k)


@pytest.mark.parametrize("surface,log,profile", [("RC", "rc_events", TL.rc_profile), ("IL", "il_events", TL.il_profile)])
def test_state_equals_the_batch_profile(spark, scratch, surface, log, profile):
    """Whatever the order of the batches, and with batches that come again."""
    df = getattr(roles(spark, SMOKE), log)
    done = [ST.apply_batch(spark, scratch, surface, k, batch_of(df, k)) for k in (2, 0, 0, 3, 2, 1)]
    assert done == [True, True, False, True, False, True]
    assert same(ST.read_profile(spark, scratch, surface), profile(df))
    assert latest(spark, scratch)["batches"] == {surface: [[0, 3]]}
    ST.fold(spark, scratch, surface)
    assert len(latest(spark, scratch)["layers"][surface]) == 1
    assert same(ST.read_profile(spark, scratch, surface), profile(df))


def test_a_batch_writes_the_accounts_it_touches(spark, scratch):
    first = spark.createDataFrame([(f"a{k}", "x", "2024-01-01", "s") for k in range(500)] + [(None, None, "junk", None)], EVENTS)
    late = spark.createDataFrame([("a7", "x", "2023-12-01", "t"), ("a7", "y", None, None)], EVENTS)
    ST.apply_batch(spark, scratch, "IL", 0, first)
    ST.apply_batch(spark, scratch, "IL", 1, late)
    layers = ST._layers(latest(spark, scratch), "IL")
    assert [r.account_id for r in spark.read.parquet(f"{layers[1]}/accounts").collect()] == ["a7"]
    assert len(glob.glob(f"{layers[1]}/detail/bucket=*")) == 1
    assert same(ST.read_profile(spark, scratch, "IL"), TL.il_profile(first.unionByName(late)))
    # Only the batch's buckets of the old layer are read.
    old = ST._newest(spark, layers[:1], "detail", ["account_id", "session_id"], [3])
    scan = [ln for ln in dry_run(old).splitlines() if "PartitionFilters" in ln]
    assert scan and "bucket" in scan[0]


def test_two_updates_at_once_both_count(spark, scratch):
    df = roles(spark, SMOKE).rc_events
    ST.apply_batch(spark, scratch, "RC", 0, batch_of(df, 0))
    threads = [threading.Thread(target=ST.apply_batch, args=(spark, scratch, "RC", k, batch_of(df, k))) for k in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert same(ST.read_profile(spark, scratch, "RC"), TL.rc_profile(df))


def test_many_layers_are_folded_and_old_folders_go(spark, scratch, monkeypatch):
    monkeypatch.setattr(ST, "MOST_LAYERS", 2)
    df = roles(spark, SMOKE).rc_events
    for k in range(4):
        ST.apply_batch(spark, scratch, "RC", k, batch_of(df, k))
    assert len(latest(spark, scratch)["layers"]["RC"]) < 3
    assert same(ST.read_profile(spark, scratch, "RC"), TL.rc_profile(df))


def test_a_refresh_from_the_state_equals_one_from_the_logs(spark, scratch):
    from tidemark.functions import vocabulary as V
    from tidemark.plans.refresh import run_all
    src = roles(spark, SMOKE)
    for surface, log in (("RC", "rc_events"), ("IL", "il_events")):
        for k in (1, 0):
            ST.apply_batch(spark, f"{scratch}/state", surface, k, batch_of(getattr(src, log), k, 2))
    run_all(spark, src, ORDERS_AS_OF, f"{scratch}/a", events_as_of=EVENTS_AS_OF, state=f"{scratch}/state")
    run_all(spark, src, ORDERS_AS_OF, f"{scratch}/b", events_as_of=EVENTS_AS_OF)
    for table in [*V.MART_TABLES.values(), V.MASTER_TABLE]:
        assert same(*(spark.read.parquet(f"{scratch}/{d}/{table}") for d in "ab")), table


def test_compaction_prunes_and_removes_partials(spark, scratch):
    rc = roles(spark, SMOKE).rc_events
    for k in range(3):
        batch_of(rc, k, 3).write.parquet(f"{scratch}/in/{k}")
        R.start_incremental_rollup(spark, f"{scratch}/in/*", SOURCE_SCHEMAS["rc_events"], "RC", f"{scratch}/r",
                                   f"{scratch}/ckpt").awaitTermination()
        if k < 2:
            R.compact(spark, f"{scratch}/r", f"c{k}")
    assert sorted(os.listdir(f"{scratch}/r/partials/surface=RC")) == ["batch_id=1", "batch_id=2"]
    whole = R.read_rollup(spark, f"{scratch}/r")
    scans = [ln for ln in dry_run(whole).splitlines() if "PartitionFilters" in ln]
    assert any("batch_id" in ln and "> 1" in ln for ln in scans)
    assert same(whole, R.daily_partials(rc, "RC"))


def test_restage_reads_the_source_once_and_only_touched_days(spark, scratch, monkeypatch):
    rows = [("a", "2024-03-01"), ("b", "2024-03-02"), ("c", "2024-03-03"), ("d", "junk")]
    df = spark.createDataFrame(rows, "account_id string, event_time string")
    for place in ("raw", "staged"):
        df.withColumn("event_day", R.parse_date("event_time")).write.partitionBy("event_day").parquet(f"{scratch}/{place}")
    raw = spark.read.parquet(f"{scratch}/raw")
    seen = []
    monkeypatch.setattr("tidemark.sources.staging.by_day", lambda d, col: seen.append(dry_run(d)) or d)
    touched = df.filter("account_id IN ('b', 'd')").select(R.parse_date("event_time").alias("event_day"))
    R.restage_days(raw, f"{scratch}/staged", "event_time", "event_day", touched)
    scans = [ln for ln in seen[0].splitlines() if "PartitionFilters" in ln]
    assert len(seen) == 1 and len(scans) == 1 and "event_day" in scans[0]
    assert sorted(r.account_id for r in spark.read.parquet(f"{scratch}/staged").collect()) == ["a", "b", "c", "d"]
