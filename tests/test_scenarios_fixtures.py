"""Boundary fixtures per scenario: rows that must and must not match
(n vs n+1 days, NULL, '', junk dates, soft deletes, fan-out, ties)."""

import datetime as dt

from fixtures import AS_OF, account, customer, days_ago, sources, ts_ago
from tidemark.functions import vocabulary as V
from tidemark.plans import scenarios as S
from tidemark.plans.master import latest_contract, master_account


def ids(df, col):
    return sorted(r[0] for r in df.select(col).collect())


def ev(acct, name, n_days_ago, session=None, junk=False):
    t = "n/a" if junk else ts_ago(n_days_ago).isoformat(sep=" ")
    return {"account_id": f"platform:{acct}", "tracked_event_name": name, "event_time": t,
            "session_id": session}


def test_s1_csm_assignment(spark):
    src = sources(
        spark,
        account=[account("A1", customer_success_associate_c=None),
                 account("A2", customer_success_associate_c="", active_product_lines_c="x; angles PROFESSIONAL"),
                 account("A3", customer_success_associate_c=None),
                 account("A4"),
                 account("A5", customer_success_associate_c=None),
                 account("A6", customer_success_associate_c=None, _fivetran_deleted=True),
                 account("A7", customer_success_associate_c=None)],
        contract=[{"contract_id": i, "account_id": a, "status": st, "customer_signed_date": days_ago(d),
                   "_fivetran_deleted": dl}
                  for i, (a, st, d, dl) in enumerate([
                      ("A1", "Activated", 2, False), ("A2", "Activated", 5, False),
                      ("A3", "Activated", 1, False), ("A4", "Activated", 9, False),
                      ("A5", "Draft", 9, False), ("A6", "Activated", 9, False),
                      ("A7", "Activated", 9, True)])])
    out = S.scn_01(src, AS_OF)
    assert ids(out, "sfdc_account_id") == ["A1", "A2"]
    assert {r.days_since_signature for r in out.collect()} == {2, 5}


def test_s2_key_never_used(spark):
    k = lambda cid, d, **kw: {"customerid": cid, "assigneduser": f"u{cid}{d}", "dateassigned": days_ago(d),  # noqa
                              "registered": True, "_fivetran_deleted": False, **kw}
    src = sources(spark, license_customer=[customer(1, "A1")],
                  license_key=[k(1, 3), k(1, 2), k(1, 5, deactivated=days_ago(1)),
                               k(1, 6, lastvalidateddate=days_ago(1)), k(1, 7, registered=None)])
    out = S.scn_02(src, AS_OF).collect()
    assert [(r.assigned_user, r.days_since_assigned, r.account_type) for r in out] == [("u13", 3, None)]


def test_s3_homepage(spark):
    src = sources(spark, login=[{"account_id": f"platform:{a}", "date": days_ago(1)} for a in ("1", "2", "3")],
                  rc_events=[ev("1", V.RC_LINEOS, 1), ev("3", V.RC_HOME, 1)])
    assert ids(S.scn_03(src), "telemetry_account_id") == ["platform:1", "platform:2"]


def test_s4_upload_stall(spark):
    u = lambda cid, d: {"customerid": cid, "assigneduser": "x", "lastvalidateddate": ts_ago(d)}  # noqa
    src = sources(spark, license_customer=[customer(1, "A1"), customer(2, "A2"), customer(3, "A3")],
                  license_usage=[u(1, 4), u(2, 3), u(3, 9)],
                  rc_events=[ev("1", V.RC_UPLOAD_CLICKED, 1), ev("3", V.RC_UPLOAD_PAGE, 1)])
    out = S.scn_04(src, AS_OF).collect()
    assert [(r.licensing_customer_id, r.clicked_upload, r.reached_upload_page) for r in out] == [(1, 1, 0)]


def test_s5_feature_gap(spark):
    usage = [{"customerid": 1, "assigneduser": "a", "lastvalidateddate": ts_ago(d, h)}
             for d in range(30) for h in (1, 2)]
    usage += [{"customerid": 2, "assigneduser": "a", "lastvalidateddate": ts_ago(d)} for d in range(29)]
    usage += [{"customerid": 3, "assigneduser": "a", "lastvalidateddate": ts_ago(d)} for d in range(40)]
    src = sources(spark, license_customer=[customer(1, "A1"), customer(2, "A2"), customer(3, "A3")],
                  license_usage=usage, rc_events=[ev("3", V.RC_VIEW_ALL, 1)])
    out = S.scn_05(src).collect()
    assert [(r.licensing_customer_id, r.active_days, r.active_span_days) for r in out] == [(1, 30, 29)]


def test_s6_schedule_dropoff(spark):
    src = sources(spark, rc_events=[
        ev("1", V.RC_SCHEDULE_PAGE, 6), ev("1", V.RC_SCHEDULE_PAGE, 0, junk=True),
        ev("2", V.RC_SCHEDULE_PAGE, 5),
        ev("3", V.RC_SCHEDULE_PAGE, 9), ev("3", V.RC_SCHEDULE_CREATED, 8),
        ev("4", V.RC_SCHEDULE_PAGE, 9, junk=True)])
    out = S.scn_06(src, AS_OF).collect()
    assert [(r.telemetry_account_id, r.schedule_page_visits, r.days_since_first_visit) for r in out] == \
        [("platform:1", 2, 6)]


def test_s7_il_never_entered(spark):
    src = sources(spark,
                  rc_events=[ev("1", V.RC_HOME, 7), ev("2", V.RC_HOME, 6), ev("3", V.RC_HOME, 9)],
                  il_events=[{**ev("1", None, 1)}, ev("3", V.IL_HOME, 1)])
    out = S.scn_07(src, AS_OF).collect()
    assert [(r.telemetry_account_id, r.days_in_rc, r.total_il_events) for r in out] == [("platform:1", 7, 0)]


def test_s8_and_s9_rule_funnel(spark):
    src = sources(spark, il_events=[
        ev("1", V.IL_HOME, 3, "s1"), ev("1", V.IL_RESULTS, 3, "s2"),
        ev("2", V.IL_HOME, 3, "s1"), ev("2", V.IL_SAVE_RULE, 3, "s1"),
        ev("3", V.IL_RESULTS, 3, "s1"),
        ev("4", V.IL_SAVE_RULE, 8, "s1"), ev("5", V.IL_SAVE_RULE, 7, "s1"),
        ev("6", V.IL_SAVE_RULE, 9, "s1"), ev("6", V.IL_RESULTS, 1, "s2")])
    s8 = S.scn_08(src).collect()
    assert [(r.telemetry_account_id, r.viewed_results_only, r.total_il_sessions) for r in s8] == \
        [("platform:1", 1, 2)]
    assert ids(S.scn_09(src, AS_OF), "telemetry_account_id") == ["platform:4"]


def test_s10_overlapping_windows(spark):
    ref = dt.datetime(AS_OF.year, AS_OF.month, AS_OF.day, 9)
    d30 = dt.datetime.combine(AS_OF - dt.timedelta(days=30), dt.time())
    u = lambda cid, user, t: {"customerid": cid, "assigneduser": user, "lastvalidateddate": t}  # noqa
    usage = [u(10, f"u{i}", ts_ago(45)) for i in range(1, 7)] + [u(10, "u1", ref), u(10, "u7", d30)]
    usage += [u(11, f"u{i}", ts_ago(45)) for i in range(1, 5)]
    usage += [u(12, f"u{i}", ts_ago(45)) for i in range(1, 7)] + [u(12, f"u{i}", ts_ago(2)) for i in (1, 2, 3)]
    usage += [u(13, f"u{i}", ts_ago(45)) for i in range(1, 7)]
    src = sources(spark, license_usage=usage,
                  license_customer=[customer(10, "A"), customer(11, "B"), customer(12, "C"),
                                    customer(13, "D", _fivetran_deleted=True)])
    out = S.scn_10(src).collect()
    assert [(r.licensing_customer_id, r.active_users_prev_30d, r.active_users_curr_30d,
             r.utilization_retention_pct) for r in out] == [(10, 7, 2, 28.6)]


def test_s11_dormant_seats(spark):
    def keys(cid, n, dormant, **kw):
        return [{"customerid": cid, "assigneduser": f"c{cid}u{i}", "registered": True,
                 "_fivetran_deleted": False,
                 "lastvalidateddate": (None if i == 0 else days_ago(40)) if i < dormant else days_ago(1), **kw}
                for i in range(n)]
    accts = [account("T0", next_renewal_date_c=AS_OF), account("T120", next_renewal_date_c=days_ago(-120)),
             account("T121", next_renewal_date_c=days_ago(-121)), account("P30", next_renewal_date_c=AS_OF)]
    custs = [customer(1, "T0"), customer(2, "T120"), customer(3, "T121"), customer(4, "P30")]
    k = keys(1, 10, 4) + keys(2, 10, 4) + keys(3, 10, 4) + keys(4, 10, 3)
    k += [{"customerid": 4, "assigneduser": "gone", "registered": True, "deactivated": days_ago(1),
           "_fivetran_deleted": False}]
    out = S.scn_11(sources(spark, account=accts, license_customer=custs, license_key=k), AS_OF).collect()
    assert sorted((r.sfdc_account_id, r.days_to_renewal, r.dormancy_pct) for r in out) == \
        [("T0", 0, 40.0), ("T120", 120, 40.0)]


def test_s12_login_without_il(spark):
    lg = lambda a, d: {"account_id": f"platform:{a}", "date": days_ago(d)}  # noqa
    src = sources(spark, login=[lg("1", 14), lg("2", 14), lg("3", 15)],
                  il_events=[ev("1", V.IL_HOME, 15), ev("2", V.IL_HOME, 14)])
    out = S.scn_12(src, AS_OF).collect()
    assert [(r.telemetry_account_id, r.health_signal, r.il_events_14d) for r in out] == \
        [("platform:1", V.SIGNAL_LOGIN_ONLY, 0)]
    full = {r.telemetry_account_id: r.health_signal for r in S.scn_12(src, AS_OF, only_alerts=False).collect()}
    assert full == {"platform:1": V.SIGNAL_LOGIN_ONLY, "platform:2": V.SIGNAL_LOW_IL}


def test_s13_engagement_drop(spark):
    src = sources(spark, il_events=[
        ev("1", V.IL_SAVE_RULE, 61, "a"), ev("1", V.IL_RESULTS, 2, "b"),
        ev("2", V.IL_HOME, 15, "a"),
        ev("3", V.IL_SAVE_RULE, 60, "a"), ev("3", V.IL_RESULTS, 30, "b"),
        ev("4", V.IL_HOME, 14, "a")])
    assert ids(S.scn_13(src, AS_OF), "telemetry_account_id") == ["platform:1", "platform:2"]


def test_s14_tiers_and_distinct_users(spark):
    r = days_ago(-30)
    accts = [account("R", totango_totango_account_health_c="Poor", next_renewal_date_c=r),
             account("A", totango_totango_account_health_c="Average", next_renewal_date_c=r),
             account("C", open_support_cases_c=6, next_renewal_date_c=r),
             account("G", next_renewal_date_c=r),
             account("X", next_renewal_date_c=days_ago(-121)),
             account("P", active_product_lines_c="Other", next_renewal_date_c=r)]
    custs = [customer(1, "G"), customer(2, "G")]
    usage = [{"customerid": c, "assigneduser": "same-name", "lastvalidateddate": ts_ago(3)} for c in (1, 2)]
    out = {x.sfdc_account_id: (x.risk_tier, x.active_licensed_users_30d)
           for x in S.scn_14(sources(spark, account=accts, license_customer=custs, license_usage=usage),
                             AS_OF).collect()}
    assert out == {"R": ("RED", 0), "A": ("AMBER", 0), "C": ("AMBER", 0), "G": ("GREEN", 1)}


def test_s15_lapsed_maintenance(spark):
    u = lambda cid, d: {"customerid": cid, "assigneduser": "x", "lastvalidateddate": ts_ago(d, 0)}  # noqa
    custs = [customer(1, "A", onmaintenance=False), customer(2, "B", onmaintenance=False),
             customer(3, "C", onmaintenance=None), customer(4, "D")]
    src = sources(spark, license_customer=custs, license_usage=[u(1, 30), u(2, 31), u(3, 1), u(4, 1)])
    assert ids(S.scn_15(src, AS_OF), "licensing_customer_id") == [1]


def test_s16_closed_lost_audit(spark):
    opp = lambda i, a, **kw: {"id": i, "account_id": a, "stage_name": V.STAGE_CLOSED_LOST,  # noqa
                              "product_line_c": V.PRODUCT_LINE, "_fivetran_deleted": False, **kw}
    src = sources(spark, account=[account("A1"), account("A2")],
                  opportunity=[opp("o1", "A1"), opp("o2", "A2"), opp("o3", "A1", product_line_c="Other"),
                               opp("o4", "A1", stage_name="Open")],
                  il_events=[ev("A2", V.IL_HOME, 3)])
    out = {r.opportunity_id: (r.ever_used_intelligence_layer, r.ever_saved_rule, r.users_at_churn)
           for r in S.scn_16(src).collect()}
    assert out == {"o1": (0, 0, 0), "o2": (1, 0, 0)}


def test_latest_contract_null_date_wins_and_ties_are_stable(spark):
    k = lambda i, a, d: {"contract_id": i, "account_id": a, "status": "Activated",  # noqa
                         "customer_signed_date": d, "_fivetran_deleted": False}
    src = sources(spark, contract=[k(1, "A", days_ago(5)), k(2, "A", None), k(3, "B", days_ago(5)),
                                   k(4, "B", days_ago(5))])
    got = {r.account_id: r.contract_id for r in latest_contract(src).collect()}
    assert got == {"A": 2, "B": 4}


def test_master_rows_and_flags(spark):
    accts = [account("A1", customer_success_associate_c=None), account("A2"), account("A3", _fivetran_deleted=True)]
    users = [{"id": "u1", "name": "Csm", "email": "c@x", "_fivetran_deleted": True}]
    custs = [customer(1, "A1"), customer(2, "A1")]
    contracts = [{"contract_id": 1, "account_id": "A1", "status": "Activated",
                  "customer_signed_date": days_ago(9), "_fivetran_deleted": False}]
    src = sources(spark, account=accts, user=users, license_customer=custs, contract=contracts)
    frames = {"S1": S.scn_01(src, AS_OF), "S3": S.scn_03(src)}
    rows = master_account(src, frames, AS_OF).collect()
    assert sorted((r.sfdc_account_id, r.licensing_customer_id) for r in rows) == \
        [("A1", 1), ("A1", 2), ("A2", None)]
    a1 = [r for r in rows if r.sfdc_account_id == "A1"][0]
    assert a1.in_s1_csm_not_assigned and a1.active_scenario_count == 1
    assert all(r.csm_name is None for r in rows)


# ---------------------------------------------------------------- options (Q10, Q13, Q26, Q27)

def test_s10_exclusive_windows(spark):
    ref = dt.datetime(AS_OF.year, AS_OF.month, AS_OF.day, 9)
    d30 = dt.datetime.combine(AS_OF - dt.timedelta(days=30), dt.time())
    u = lambda user, t: {"customerid": 10, "assigneduser": user, "lastvalidateddate": t}  # noqa
    usage = [u(f"u{i}", ts_ago(45)) for i in range(1, 7)] + [u("u1", ref), u("u7", d30)]
    src = sources(spark, license_usage=usage, license_customer=[customer(10, "A")])
    incl = S.scn_10(src).first()
    excl = S.scn_10(src, exclusive=True).first()
    assert (incl.active_users_prev_30d, excl.active_users_prev_30d) == (7, 6)
    assert excl.utilization_retention_pct == 33.3


def test_s13_spec_semantics(spark):
    src = sources(spark, il_events=[ev("3", V.IL_SAVE_RULE, 60, "a"), ev("3", V.IL_RESULTS, 30, "b")])
    assert S.scn_13(src, AS_OF).count() == 0
    assert ids(S.scn_13(src, AS_OF, spec_semantics=True), "telemetry_account_id") == ["platform:3"]


def test_s3_requires_active_license(spark):
    src = sources(spark, login=[{"account_id": f"platform:{a}", "date": days_ago(1)} for a in ("1", "2")],
                  license_customer=[customer(1, "A1"), customer(2, "A2")],
                  license_usage=[{"customerid": 1, "assigneduser": "x", "lastvalidateddate": ts_ago(3)},
                                 {"customerid": 2, "assigneduser": "x", "lastvalidateddate": ts_ago(40)}])
    assert ids(S.scn_03(src), "telemetry_account_id") == ["platform:1", "platform:2"]
    assert ids(S.scn_03(src, require_active_license_days=30, as_of=AS_OF), "telemetry_account_id") == \
        ["platform:1"]


def test_s16_bounded_by_close_date(spark):
    opp = {"id": "o1", "account_id": "A1", "stage_name": V.STAGE_CLOSED_LOST, "close_date": days_ago(10),
           "product_line_c": V.PRODUCT_LINE, "_fivetran_deleted": False}
    opp2 = dict(opp, id="o2", close_date=days_ago(1))
    u = lambda user, d: {"customerid": 1, "assigneduser": user, "lastvalidateddate": ts_ago(d)}  # noqa
    src = sources(spark, account=[account("A1")], opportunity=[opp, opp2],
                  il_events=[ev("A1", V.IL_HOME, 5)], license_customer=[customer(1, "A1")],
                  license_usage=[u("u1", 20), u("u1", 12), u("u2", 3)])
    plain = {r.opportunity_id: (r.ever_used_intelligence_layer, r.users_at_churn) for r in S.scn_16(src).collect()}
    assert plain == {"o1": (1, 2), "o2": (1, 2)}
    bounded = {r.opportunity_id: (r.ever_used_intelligence_layer, r.users_at_churn, r.last_license_use_date)
               for r in S.scn_16(src, as_of_close=True).collect()}
    assert bounded == {"o1": (0, 1, ts_ago(12)), "o2": (1, 2, ts_ago(3))}


def test_master_one_row_per_account_and_severity(spark):
    accts = [account("A1"), account("A2")]
    custs = [customer(2, "A1"), customer(1, "A1", webid=None)]
    src = sources(spark, account=accts, license_customer=custs)
    rows = {r.sfdc_account_id: (r.licensing_customer_id, r.platform_web_id, r.licensing_customers)
            for r in master_account(src, {}, AS_OF, one_row_per_account=True).collect()}
    assert rows == {"A1": (1, None, 2), "A2": (None, None, 0)}
    tiers = spark.createDataFrame([("GREEN",), ("RED",), ("AMBER",)], "risk_tier string")
    assert [r[0] for r in tiers.orderBy(S.risk_severity()).collect()] == ["RED", "AMBER", "GREEN"]


def test_s1_one_onboarding_row(spark):
    src = sources(spark, account=[account("A1", customer_success_associate_c=None)],
                  contract=[{"contract_id": i, "account_id": "A1", "status": "Activated",
                             "customer_signed_date": days_ago(3 + i), "_fivetran_deleted": False} for i in range(2)],
                  onboarding=[{"account_c": "A1", "stage_c": st, "status_c": "x"} for st in ("a", "b", "c")])
    assert S.scn_01(src, AS_OF).count() == 6
    rows = S.scn_01(src, AS_OF, one_onboarding_row=True).collect()
    assert len(rows) == 2 and {r.onboarding_stage for r in rows} == {"c"}


def test_scenario_labels_sort_numerically(spark):
    from tidemark.plans.master import scenario_order
    df = spark.createDataFrame([("S10",), ("MASTER",), ("S2",), ("S1",)], "scenario string")
    assert [r[0] for r in df.orderBy(scenario_order()).collect()] == ["S1", "S2", "S10", "MASTER"]
