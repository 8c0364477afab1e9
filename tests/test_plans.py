"""Plan-shape tests: the physical plans we want at scale."""

import pytest

from places import SF001
from tidemark.plans import scenarios as S
from tidemark.plans.master import latest_contract
from tidemark.publish.publish import dry_run
from tidemark.registry import QUERIES
from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, roles


def plan(df) -> str:
    return dry_run(df, "formatted")


@pytest.fixture(scope="module")
def src(spark):
    return roles(spark, SF001)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("scn_")])
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("fn", [lambda s: S.scn_03(s), lambda s: S.scn_07(s, EVENTS_AS_OF),
                                lambda s: S.scn_12(s, ORDERS_AS_OF)])
def test_never_did_is_anti_join(src, fn):
    assert "LeftAnti" in plan(fn(src))


def test_distinct_counts_without_expand(src):
    for df in (S.scn_08(src), S.scn_13(src, EVENTS_AS_OF), S.scn_11(src, ORDERS_AS_OF)):
        assert "Expand" not in plan(df)


def test_age_predicate_reaches_scan(spark, tmp_path):
    # The driver tables derive dates through casts; use a stored role table
    # to check that a sargable age predicate is pushed into the scan.
    src = roles(spark, SF001)
    path = str(tmp_path / "license_key")
    src.license_key.write.parquet(path)
    keys = spark.read.parquet(path)
    p = plan(S.scn_02(src.with_(license_key=keys), ORDERS_AS_OF))
    scan = [ln for ln in p.splitlines() if "PushedFilters" in ln and "dateassigned" in ln]
    assert scan and "LessThan(dateassigned" in scan[0]


def test_latest_row_uses_group_limit(src):
    assert "WindowGroupLimit" in plan(latest_contract(src))


def test_pre_aggregation_before_join(src):
    """S16 aggregates usage per account before joining opportunities: the
    HashAggregate over usage sits below the join, not above it."""
    p = plan(S.scn_16(src))
    assert p.count("HashAggregate") >= 4


def test_building_a_mart_runs_no_job(spark, src):
    from tidemark.plans.refresh import default_builders
    sc, group = spark.sparkContext, "no-job-at-build"
    sc.setJobGroup(group, "building plans")
    try:
        for build in default_builders(ORDERS_AS_OF, EVENTS_AS_OF).values():
            build(src)
        S.scn_16(src, as_of_close=True)
        assert not sc.statusTracker().getJobIdsForGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_a_plan_builds_only_the_roles_it_reads(spark):
    """S9 needs the IL events: no other role is analysed and no file opened."""
    src = roles(spark, SF001)
    sc, group = spark.sparkContext, "no-job-for-roles"
    sc.setJobGroup(group, "building roles")
    try:
        S.scn_09(src, EVENTS_AS_OF)
        assert not sc.statusTracker().getJobIdsForGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [r for r, df in src._roles.items() if not callable(df)] == ["il_events"]


def test_candidate_keys_pass_no_single_task(src):
    for df in (S.scn_11(src, ORDERS_AS_OF), S.scn_14(src, ORDERS_AS_OF), S.scn_15(src, ORDERS_AS_OF), S.scn_16(src)):
        p = plan(df)
        assert "SinglePartition" not in p and "GlobalLimit" not in p


def test_each_log_is_scanned_once_per_refresh(spark, scratch, monkeypatch):
    """With profiles, no mart's plan reads a log; each profile reads its log once."""
    from tidemark.plans import refresh as R
    from tidemark.plans.telemetry import telemetry_profiles
    from tidemark.sources.staging import materialize_sources
    staged = materialize_sources(spark, roles(spark, SF001), f"{scratch}/st")
    prof = telemetry_profiles(staged)
    for log, name in (("rc_events", "rc"), ("il_events", "il"), ("license_usage", "usage"), ("login", "login")):
        p = dry_run(getattr(prof, name), "simple")
        assert sum("FileScan" in ln and f"/st/{log}" in ln for ln in p.splitlines()) == 1
    tel = R.write_profiles(spark, staged, f"{scratch}/prof")
    for build in R.default_builders(ORDERS_AS_OF, EVENTS_AS_OF, tel=tel).values():
        p = dry_run(build(staged), "simple")
        for log in ("rc_events", "il_events", "license_usage", "login"):
            assert f"/st/{log}" not in p


def test_s10_window_reaches_scan(spark, tmp_path):
    src = roles(spark, SF001)
    path = str(tmp_path / "usage")
    src.license_usage.write.parquet(path)
    p = plan(S.scn_10(src.with_(license_usage=spark.read.parquet(path)), ORDERS_AS_OF, window_days=180))
    scan = [ln for ln in p.splitlines() if "PushedFilters" in ln and "lastvalidateddate" in ln]
    assert scan and "GreaterThanOrEqual(lastvalidateddate" in scan[0]


@pytest.fixture(scope="module")
def profiled(spark, tmp_path_factory):
    """Staged roles and the profiles written from them."""
    from tidemark.plans import refresh as R
    from tidemark.sources.staging import materialize_sources
    root = str(tmp_path_factory.mktemp("profiled"))
    staged = materialize_sources(spark, roles(spark, SF001), f"{root}/st")
    return staged, R.write_profiles(spark, staged, f"{root}/prof")


def test_keys_and_usage_per_customer_are_read_from_profiles(profiled):
    """No mart's plan reads the license keys; S4 and S5 share one reduction of
    the usage to a row per customer."""
    from tidemark.plans import refresh as R
    staged, tel = profiled
    builders = R.default_builders(ORDERS_AS_OF, EVENTS_AS_OF, tel=tel)
    for build in builders.values():
        assert "/st/license_key" not in dry_run(build(staged), "simple")
    for sid in ("S4", "S5"):
        p = dry_run(builders[sid](staged), "simple")
        assert "/prof/use]" in p and "/prof/usage]" not in p


def test_marts_of_profiles_are_those_of_the_logs(profiled):
    from tidemark.plans import refresh as R
    staged, tel = profiled
    shared, plain = (R.default_builders(ORDERS_AS_OF, EVENTS_AS_OF, tel=t) for t in (tel, None))
    for sid in ("S2", "S3", "S4", "S5", "S11", "S14", "S16"):
        a, b = shared[sid](staged), plain[sid](staged)
        assert a.schema.simpleString() == b.schema.simpleString()
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_event_days_are_parsed_once_per_event(src):
    from tidemark.plans.telemetry import il_profile, rc_profile
    for df in (rc_profile(src.rc_events), il_profile(src.il_events)):
        assert all("try_to_date" not in ln and "RLIKE" not in ln and "gettimestamp" not in ln
                   for ln in dry_run(df, "simple").splitlines() if "Aggregate" in ln)


def test_telemetry_marts_pass_the_bridge_in_one_join(spark, src):
    from tidemark.operators.bridge import telemetry_bridge
    from tidemark.plans.master import membership_rows, memberships
    bridge = telemetry_bridge(src)
    keys = spark.createDataFrame([("platform:1",), ("platform:2",), ("platform:2",), (None,), ("platform:no",)],
                                 "telemetry_account_id string")
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "sfdc_account_id string")
    joins = lambda df: sum("Join" in ln for ln in dry_run(df, "simple").splitlines())
    frames = {"S1": ids, "S3": keys, "S6": keys, "S7": keys}
    assert joins(membership_rows(frames, bridge)) == joins(bridge) + 1
    reached = {r.sfdc_account_id for r in bridge.collect() if r.telemetry_account_id in ("platform:1", "platform:2")}
    assert reached and {tuple(r) for r in memberships(frames, bridge).collect()} == {
        ("a", "S1"), *((x, s) for x in reached for s in ("S3", "S6", "S7"))}
