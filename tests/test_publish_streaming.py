"""Publishing (write aside, validate, announce), reads, and the incremental
rollup (availableNow stream equals the batch rollup; replays are idempotent)."""

import pytest
from pyspark.sql import functions as F

from places import SF001, SMOKE
from tidemark.plans import scenarios as S
from tidemark.publish import publish as PB
from tidemark.sources.schemas import SOURCE_SCHEMAS
from tidemark.sources.staging import blank_to_null, to_bool
from tidemark.sources.testmap import EVENTS_AS_OF, roles
from tidemark.streaming import rollup as R


def test_publish_and_read(spark, scratch):
    src = roles(spark, SMOKE)
    mart = S.scn_06(src, EVENTS_AS_OF)
    v1 = PB.publish(spark, mart, scratch, "S6", validate=lambda d: d.count() >= 0, run_id="r1")
    assert v1["rows"] == mart.count()
    got = PB.read_mart(spark, scratch, "S6", order_by=[F.col("schedule_page_visits").desc()], limit=1)
    assert got.count() == min(1, v1["rows"])


def test_failed_validation_keeps_previous_version(spark, scratch):
    src = roles(spark, SMOKE)
    PB.publish(spark, S.scn_08(src), scratch, "S8", run_id="good")
    with pytest.raises(ValueError):
        PB.publish(spark, S.scn_08(src), scratch, "S8", validate=lambda d: False, run_id="bad")
    assert PB.current_version(spark, scratch, "S8")["run_id"] == "good"


def test_observed_write_counts_in_same_pass(spark, scratch):
    df = roles(spark, SMOKE).login
    n, line = PB.observed_write(df, f"{scratch}/login", "LOGIN")
    assert n == df.count() and line.startswith("[LOGIN] ")


def test_masking(spark):
    df = spark.createDataFrame([("a@b.c", 1)], "user_email string, n int")
    out = PB.mask_columns(df, ["user_email"]).first()
    assert out.user_email != "a@b.c" and len(out.user_email) == 64
    salted = PB.mask_columns(df, ["user_email"], salt="secret").first()
    assert salted.user_email not in ("a@b.c", out.user_email)
    with pytest.raises(ValueError):
        PB.mask_columns(df, ["user_emial"])


def test_incremental_rollup_equals_batch(spark, scratch):
    src = roles(spark, SMOKE)
    rc = src.rc_events
    # Land the source in two files so the stream sees more than one file.
    rc.filter(F.col("event_time") < "2024-01-15").write.parquet(f"{scratch}/in/a")
    rc.filter(~(F.col("event_time") < "2024-01-15")).write.parquet(f"{scratch}/in/b")
    q = R.start_incremental_rollup(spark, f"{scratch}/in/*", SOURCE_SCHEMAS["rc_events"], "RC",
                                   f"{scratch}/rollup", f"{scratch}/ckpt")
    q.awaitTermination()
    inc = R.read_rollup(spark, f"{scratch}/rollup")
    batch = R.daily_partials(rc, "RC").select(*inc.columns)
    assert inc.exceptAll(batch).count() == 0 and batch.exceptAll(inc).count() == 0


def test_refresh_from_the_rollup_equals_refresh_from_the_logs(spark, scratch):
    """With late rows, and with a compaction between the batches."""
    from tidemark.functions import vocabulary as V
    from tidemark.plans.refresh import run_all
    from tidemark.sources.testmap import ORDERS_AS_OF
    src = roles(spark, SMOKE)

    def feed(part):
        for surface, log in (("RC", "rc_events"), ("IL", "il_events")):
            df = getattr(src, log)
            late = F.pmod(F.crc32("account_id"), F.lit(3)) == 0
            df.filter(late if part == "late" else ~late).write.parquet(f"{scratch}/in/{log}/{part}")
            R.start_incremental_rollup(spark, f"{scratch}/in/{log}/*", SOURCE_SCHEMAS[log], surface, f"{scratch}/rollup",
                                       f"{scratch}/ckpt-{log}").awaitTermination()

    feed("first")
    before = R.read_rollup(spark, f"{scratch}/rollup").count()
    R.compact(spark, f"{scratch}/rollup", "c1")
    assert R.read_rollup(spark, f"{scratch}/rollup").count() == before
    feed("late")
    whole = R.read_rollup(spark, f"{scratch}/rollup")
    want = R.event_daily_rollup(src.rc_events, src.il_events).select(*whole.columns)
    assert whole.exceptAll(want).count() == 0 and want.exceptAll(whole).count() == 0
    R.compact(spark, f"{scratch}/rollup", "c2")
    assert R.read_rollup(spark, f"{scratch}/rollup").exceptAll(want).count() == 0
    run_all(spark, src, ORDERS_AS_OF, f"{scratch}/a", events_as_of=EVENTS_AS_OF, rollup=f"{scratch}/rollup")
    run_all(spark, src, ORDERS_AS_OF, f"{scratch}/b", events_as_of=EVENTS_AS_OF)
    for table in [*V.MART_TABLES.values(), V.MASTER_TABLE]:
        x, y = (spark.read.parquet(f"{scratch}/{d}/{table}") for d in "ab")
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, table


def test_a_gate_that_objects_keeps_the_old_refresh(spark, scratch):
    from tidemark.functions import vocabulary as V
    from tidemark.plans.refresh import contract_violations, run_all
    from tidemark.sources.testmap import ORDERS_AS_OF
    src = roles(spark, SMOKE)
    run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="good")
    with pytest.raises(ValueError, match="S14: no rows wanted"):
        run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="bad",
                gate=lambda sid, df: ["S14: no rows wanted"] if sid == "S14" else contract_violations(sid, df))
    for table in [*V.MART_TABLES.values(), V.MASTER_TABLE]:
        assert PB.current_version(spark, scratch, table)["run_id"] == "good"


@pytest.mark.parametrize("sid,change,says", [
    ("S14", lambda df: df.withColumn("days_to_renewal", F.lit(500)), "S14: invariant:window"),
    ("S6", lambda df: df.withColumn("telemetry_account_id", F.lit(None).cast("string")), "S6: not_null:telemetry_account_id"),
    ("S6", lambda df: df.withColumn("schedule_page_visits", F.lit(0).cast("long")), "S6: invariant:visits"),
    ("S11", lambda df: df.drop("dormancy_pct"), "S11.dormancy_pct: missing")])
def test_what_the_default_gate_objects_to(spark, sid, change, says):
    from tidemark.plans.refresh import default_builders, mart_violations
    from tidemark.sources.testmap import ORDERS_AS_OF
    mart = default_builders(ORDERS_AS_OF, EVENTS_AS_OF)[sid](roles(spark, SMOKE))
    assert mart_violations(sid, mart) == []
    assert [v for v in mart_violations(sid, change(mart)) if v.startswith(says)]


def test_the_default_gate_keeps_a_refresh_back(spark, scratch, monkeypatch):
    from tidemark.plans import refresh as RF
    from tidemark.sources.testmap import ORDERS_AS_OF
    monkeypatch.setitem(RF.ASSERTIONS, "S6", (10 ** 9, (), {}))
    with pytest.raises(ValueError, match="S6: min_rows:1000000000"):
        RF.run_all(spark, roles(spark, SMOKE), ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="r")
    assert PB.VS.latest(spark, scratch) is None


def test_merge_milestones_monotone(spark):
    st = spark.createDataFrame([("a", 0, "2024-01-05")], "k string, ever int, first string")
    b = spark.createDataFrame([("a", 1, "2024-01-02"), ("b", 0, "2024-01-09")], "k string, ever int, first string")
    out = {r.k: (r.ever, r.first) for r in R.merge_milestones(st, b, "k", ["ever"], ["first"]).collect()}
    assert out == {"a": (1, "2024-01-02"), "b": (0, "2024-01-09")}


def test_staging_normalisers(spark):
    df = spark.createDataFrame([("1",), ("TRUE",), ("n",), ("maybe",), ("  ",)], "v string")
    got = [tuple(r) for r in df.select(to_bool("v"), blank_to_null("v")).collect()]
    assert got == [(True, "1"), (True, "TRUE"), (False, "n"), (None, "maybe"), (None, None)]


def test_run_all_counts_match_marts(spark, scratch):
    from tidemark.plans.refresh import default_builders, run_all
    from tidemark.sources.testmap import ORDERS_AS_OF
    src = roles(spark, SMOKE)
    report = {r.scenario: r.rows for r in
              run_all(spark, src, ORDERS_AS_OF, scratch, default_builders(ORDERS_AS_OF, EVENTS_AS_OF)).collect()}
    assert report["S6"] == S.scn_06(src, EVENTS_AS_OF).count()
    assert spark.read.parquet(f"{scratch}/MTM_MASTER_ACCOUNT").count() == report["MASTER"]
    lin = spark.read.parquet(f"{scratch}/_lineage")
    assert lin.filter("kind = 'depends_on'").count() > 16
    tables = {(r.mart, r.name.rsplit("/", 1)[1]) for r in lin.filter("kind = 'input_table'").collect()}
    assert {t for m, t in tables if m == "S6"} == {"events.parquet"}
    assert {t for m, t in tables if m == "MASTER"} == {
        f"{t}.parquet" for t in ("customer", "nation", "orders", "lineitem", "events")}


def test_shared_telemetry_profiles_equal_direct_marts(spark, scratch):
    """Differential: a refresh that reads each event log once (profiles)
    produces exactly the marts of the direct, per-scenario plans."""
    from tidemark.functions import vocabulary as V
    from tidemark.plans.refresh import default_builders, run_all
    from tidemark.sources.testmap import ORDERS_AS_OF
    src = roles(spark, SF001)
    run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF)
    direct = default_builders(ORDERS_AS_OF, EVENTS_AS_OF)
    for sid in V.SCENARIO_IDS:
        got = spark.read.parquet(f"{scratch}/{V.MART_TABLES[sid]}")
        want = direct[sid](src)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, sid


def test_export_csv_dated_and_sorted(spark, scratch):
    import datetime as dt
    df = S.scn_06(roles(spark, SMOKE), EVENTS_AS_OF)
    path = PB.export_csv(df, scratch, "S6_schedule_dropoff", dt.date(2024, 1, 31),
                         order=S.order_columns(S.DEFAULT_ORDER["S6"]))
    assert path.endswith("S6_schedule_dropoff_20240131")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == df.count()


def test_contract_check_flags_breaking_changes(spark):
    from tidemark.operators.quality import contract_check
    from tidemark.sources.schemas import MART_SCHEMAS
    s6 = S.scn_06(roles(spark, SMOKE), EVENTS_AS_OF)
    assert all(st == "ok" for *_, st in contract_check(s6, MART_SCHEMAS["S6"]))
    changed = s6.withColumn("schedule_page_visits", F.col("schedule_page_visits").cast("int")).drop("last_schedule_page_visit")
    status = {n: st for n, _, _, st in contract_check(changed, MART_SCHEMAS["S6"])}
    assert status["schedule_page_visits"] == "type_changed" and status["last_schedule_page_visit"] == "missing"


def test_every_mart_matches_its_contract(spark):
    from tidemark.operators.quality import contract_check
    from tidemark.plans.refresh import default_builders
    from tidemark.sources.testmap import ORDERS_AS_OF
    from tidemark.sources.schemas import MART_SCHEMAS
    src = roles(spark, SMOKE)
    for sid, build in default_builders(ORDERS_AS_OF, EVENTS_AS_OF).items():
        bad = [r for r in contract_check(build(src), MART_SCHEMAS[sid]) if r[3] != "ok"]
        assert not bad, (sid, bad)


def test_dry_run_shows_plan_without_running(spark):
    p = PB.dry_run(S.scn_03(roles(spark, SMOKE)))
    assert "Physical Plan" in p and "LeftAnti" in p


def test_staged_sources_round_trip(spark, scratch):
    from tidemark.sources.staging import materialize_sources
    src = roles(spark, SMOKE)
    staged = materialize_sources(spark, src, f"{scratch}/staging")
    a, b = S.scn_06(src, EVENTS_AS_OF), S.scn_06(staged, EVENTS_AS_OF)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert staged.license_usage.count() == src.license_usage.count()


def test_run_scoped_refresh_is_announced_together(spark, scratch):
    from tidemark.functions import vocabulary as V
    from tidemark.plans.refresh import run_all
    from tidemark.sources.testmap import ORDERS_AS_OF
    src = roles(spark, SMOKE)
    run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="r1")
    run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="r2")
    for table in list(V.MART_TABLES.values()) + [V.MASTER_TABLE]:
        assert PB.current_version(spark, scratch, table)["run_id"] == "r2"
    diff = {r.measure: r.rows for r in PB.compare_runs(spark, scratch, V.MART_TABLES["S6"]).collect()}
    assert diff["added_rows"] == 0 and diff["removed_rows"] == 0
    s6 = PB.read_mart(spark, scratch, V.MART_TABLES["S6"])
    assert s6.count() == S.scn_06(src, EVENTS_AS_OF).count()


def test_restage_days_replaces_only_touched_partitions(spark, scratch):
    import datetime as dt
    day0 = dt.datetime(2024, 3, 1, 9)
    rows = [(c, f"u{c}", day0 + dt.timedelta(days=d)) for c in range(1, 4) for d in range(5)]
    schema = "customerid long, assigneduser string, lastvalidateddate timestamp_ntz"
    usage = spark.createDataFrame(rows, schema)
    usage_path = f"{scratch}/st/license_usage"
    (usage.withColumn("usage_day", F.col("lastvalidateddate").cast("date"))
     .write.partitionBy("usage_day").parquet(usage_path))
    late = spark.createDataFrame([(9, "late-user", day0 + dt.timedelta(days=2, hours=5))], schema)
    touched = late.select(F.col("lastvalidateddate").cast("date").alias("usage_day"))
    R.restage_days(usage.unionByName(late), usage_path, "lastvalidateddate", "usage_day", touched)
    counts = {r.usage_day: r["count"] for r in spark.read.parquet(usage_path).groupBy("usage_day").count().collect()}
    assert counts == {dt.date(2024, 3, 1 + d): (4 if d == 2 else 3) for d in range(5)}


def test_restage_keeps_rows_without_a_day_and_clears_emptied_days(spark, scratch):
    schema = "account_id string, event_time string"
    old = spark.createDataFrame([("a", "2024-03-01"), ("b", "2024-03-02"), ("c", "junk")], schema)
    path = f"{scratch}/rc"
    (old.withColumn("event_day", R.parse_date("event_time")).write.partitionBy("event_day").parquet(path))
    new = spark.createDataFrame([("a", "2024-03-01"), ("c", "junk"), ("late", "not a date"), ("d", "2024-03-03")], schema)
    touched = spark.createDataFrame([("2024-03-02",), ("2024-03-03",), (None,)], "d string").select(
        F.col("d").cast("date").alias("event_day"))
    R.restage_days(new, path, "event_time", "event_day", touched)
    assert sorted(r.account_id for r in spark.read.parquet(path).collect()) == ["a", "c", "d", "late"]


def test_a_large_day_is_written_by_several_tasks(spark, scratch):
    import glob
    from tidemark.sources.staging import by_day
    df = spark.range(400_000).select(F.lit("2024-01-01").cast("date").alias("day"), F.md5(F.col("id").cast("string")).alias("x"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        by_day(df.repartition(8), "day").write.partitionBy("day").parquet(f"{scratch}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(glob.glob(f"{scratch}/t/day=2024-01-01/*.parquet")) > 1
    assert spark.read.parquet(f"{scratch}/t").count() == 400_000


def test_partial_dates_and_quarantine_agree(spark):
    from tidemark.sources import staging as STG
    df = spark.createDataFrame([("",), ("  ",), ("x",), ("2024",), ("2024-05",), ("2024-05-01",), ("2024-05-01 07:00:00",),
                                ("05/31/2024",), ("2024/05/02",), (None,)], "t string")
    days = [None if d is None else str(d) for (d,) in df.select(R.parse_date("t")).collect()]
    assert days == [None] * 5 + ["2024-05-01", "2024-05-01", "2024-05-31", "2024-05-02", None]
    assert STG.quarantine_counts(df, {"t": "date"}, "x").first().bad_values == 3
    assert sorted(r.t for r in STG.quarantine_rows(df, {"t": "date"}).collect()) == ["2024", "2024-05", "x"]


def test_junk_rules_need_a_place_for_dropped_rows(spark, scratch):
    from tidemark.sources import staging as STG
    df = spark.createDataFrame([("a",), (None,)], "k string")
    with pytest.raises(ValueError):
        STG.stage(df, junk={"no_key": F.col("k").isNull()})
    assert STG.stage(df, junk={"no_key": F.col("k").isNull()}, dropped_to=f"{scratch}/dropped").count() == 1
    assert spark.read.parquet(f"{scratch}/dropped").filter("status = 'rejected'").first().drop_reason == "no_key"


def test_default_order_on_read(spark, scratch):
    src = roles(spark, SMOKE)
    from tidemark.functions import vocabulary as V
    from tidemark.sources.testmap import ORDERS_AS_OF
    PB.publish(spark, S.scn_11(src, ORDERS_AS_OF), scratch, V.MART_TABLES["S11"], run_id="r")
    rows = PB.read_mart(spark, scratch, V.MART_TABLES["S11"], columns=["days_to_renewal", "dormancy_pct"]).collect()
    keys = [(r.days_to_renewal, -r.dormancy_pct) for r in rows]
    assert keys == sorted(keys)


def test_csm_worklist_published_filtered_and_paged(spark, scratch):
    from tidemark.registry import QUERIES
    wl = QUERIES["csm_worklist"](spark, SMOKE)
    PB.publish(spark, wl, scratch, "CSM_WORKLIST", validate=lambda d: d.count() == wl.count(), run_id="w1")
    top = wl.groupBy("csm_id").count().orderBy(F.col("count").desc(), "csm_id").first()
    mine = F.col("csm_id") == top["csm_id"] if top["csm_id"] is not None else F.col("csm_id").isNull()
    order = [F.col("days_to_renewal").asc_nulls_last(), F.col("sfdc_account_id"), F.col("scenario")]
    first_page = PB.read_mart(spark, scratch, "CSM_WORKLIST", filters=mine, order_by=order, limit=3)
    second_page = PB.read_mart(spark, scratch, "CSM_WORKLIST", filters=mine, order_by=order, limit=3, offset=3)
    everything = [tuple(r) for r in PB.read_mart(spark, scratch, "CSM_WORKLIST", filters=mine, order_by=order).collect()]
    assert [tuple(r) for r in first_page.collect()] + [tuple(r) for r in second_page.collect()] == everything[:6]
