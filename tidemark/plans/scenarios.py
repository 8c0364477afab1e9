"""The sixteen scenario marts (SCN-01..16).

Each is ``scn_NN(src, as_of, **thresholds) -> DataFrame``; defaults are the
source literals. Output columns and grain follow the source marts exactly.

Shape rules, applied throughout:

* facts are aggregated to the output grain (account, customer, opportunity)
  *before* they meet a dimension — the source's join-then-``GROUP BY`` shape
  multiplies rows (e.g. S16: 4,933 opportunities → 2.9 M joined rows at
  sf0.01) and makes a hot account a hot shuffle partition;
* "never did X" is a ``left_anti`` join against distinct keys;
* predicates on the base tables are applied before any join (and age
  predicates are written on the raw column, so they reach the scan);
* a candidate set (accounts renewing soon, closed-lost opportunities) is
  semi-joined into the big facts first, so only their rows are aggregated;
  the key side is distinct and unhinted, so Spark picks the join by measured
  size; usage is reduced to a row per seat before it meets its customer;
* building a plan runs no job;
* with ``tel=`` (profiles of the logs, ``plans.telemetry``) the event, usage
  and login logs and the license keys are not read at all — a full refresh
  reads each log once.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.dates import as_date, day_diff, due_within, feed_as_of, older_than
from tidemark.functions.predicates import (not_deleted, null_or_empty, pct, ratio, telemetry_key,
                                           tier)
from tidemark.operators.kernels import (active_rollup, count_if, distinct, dormancy, event_date, ever, first,
                                        keys_that, last, milestones, named, never_did,
                                        running_by_day, started_not_completed, window_retention)
from tidemark.operators.joins import key_set, semi
from tidemark.sources.registry import Sources

if TYPE_CHECKING:
    from tidemark.plans.telemetry import Telemetry

c = F.col

# Default ordering of each mart (applied when reading or exporting, not at
# write): (column, "asc" | "desc"); NULLs sort high, as in the source engine.
DEFAULT_ORDER: dict[str, list[tuple[str, str]]] = {
    "S1": [("days_since_signature", "desc")],
    "S2": [("days_since_assigned", "desc")],
    "S3": [("total_login_days", "desc")],
    "S4": [("days_since_first_use", "desc")],
    "S5": [("active_days", "desc")],
    "S6": [("schedule_page_visits", "desc")],
    "S7": [("days_in_rc", "desc")],
    "S8": [("total_il_sessions", "desc")],
    "S9": [("days_since_first_rule", "desc")],
    "S10": [("active_users_prev_30d", "desc")],
    "S11": [("days_to_renewal", "asc"), ("dormancy_pct", "desc")],
    "S12": [("login_days_14d", "desc")],
    "S13": [("days_since_any_il_event", "desc")],
    "S14": [("days_to_renewal", "asc"), ("risk_tier", "asc")],
    "S15": [("users_still_active", "desc")],
    "S16": [("closed_lost_date", "desc")],
    "MASTER": [("active_scenario_count", "desc"), ("account_name", "asc")],
}


def risk_severity(col: str = "risk_tier") -> Column:
    """RED < AMBER < GREEN as 1 < 2 < 3 — ``risk_tier ASC`` alone sorts
    AMBER, GREEN, RED (Q16); order by this instead to put RED first."""
    t = F.col(col)
    return F.when(t == V.TIER_RED, 1).when(t == V.TIER_AMBER, 2).when(t == V.TIER_GREEN, 3).otherwise(4)


def order_columns(spec: list[tuple[str, str]]) -> list[Column]:
    """Sort columns with NULLs high (ASC → last, DESC → first)."""
    return [F.col(n).asc_nulls_last() if d == "asc" else F.col(n).desc_nulls_first()
            for n, d in spec]


def _account_dims(src: Sources, deleted_filter: bool = False) -> DataFrame:
    a = src.account
    if deleted_filter:
        a = a.filter(not_deleted())
    return a.select(c("id").alias("_aid"), c("type").alias("account_type"),
                    c("active_product_lines_c").alias("product_lines"),
                    c("customer_success_associate_c").alias("csm_id"),
                    c("next_renewal_date_c"), c("open_renewable_amount_c"),
                    c("contract_status_c"), c("cancellation_date_c"))


def _live_customers(src: Sources) -> DataFrame:
    return src.license_customer.filter(not_deleted())


def _usage(src: Sources, tel: Telemetry | None) -> tuple[DataFrame, str]:
    """The usage log, or its daily reduction, and the column of a row's latest
    time."""
    if tel is not None and tel.usage is not None:
        return tel.usage, "last_ts"
    return src.license_usage, "lastvalidateddate"


def _customer_use(src: Sources, tel: Telemetry | None) -> DataFrame:
    """Per customer: first_use, last_use, active_days."""
    if tel is not None and tel.use is not None:
        return tel.use
    usage, last_ts = _usage(src, tel)
    return active_rollup(usage, "customerid", "lastvalidateddate", last_ts=last_ts)


def _open_keys(src: Sources, tel: Telemetry | None) -> DataFrame:
    """Keys that are registered and not deactivated."""
    if tel is not None and tel.keys is not None:
        return tel.keys
    return src.license_key.filter((c("registered") == F.lit(True)) & c("deactivated").isNull())


def _usage_since(src: Sources, tel: Telemetry | None, as_of, days: int) -> tuple[DataFrame, str]:
    usage, last_ts = _usage(src, tel)
    if last_ts == "lastvalidateddate":
        return src.since("license_usage", last_ts, as_of, days), last_ts
    lo = F.date_sub(as_date(as_of), days)
    return usage.filter((c("usage_day") >= lo) & (c(last_ts) >= lo)), last_ts


def _logins_since(src: Sources, tel: Telemetry | None, as_of, days: int) -> DataFrame:
    if tel is not None and tel.login is not None:
        return tel.login.filter(c("date") >= F.date_sub(as_date(as_of), days))
    return src.since("login", "date", as_of, days)


def active_license_keys(src: Sources, as_of, days: int = 30) -> DataFrame:
    """Telemetry keys (``_ak``) of live licensing customers with a license
    validation in the last ``days`` — the "validated license" condition the
    S3/S7/S12 descriptions mention and their SQL omits (Q26)."""
    used = (src.since("license_usage", "lastvalidateddate", as_of, days)
            .select(c("customerid").alias("_uc")).distinct())
    return (_live_customers(src).join(used, c("customerid") == c("_uc"), "left_semi")
            .select(telemetry_key("webid").alias("_ak")).filter(c("_ak").isNotNull()).distinct())


def _with_active_license(df: DataFrame, src: Sources, as_of, days: int | None) -> DataFrame:
    if days is None:
        return df
    return df.join(active_license_keys(src, as_of, days), c("telemetry_account_id") == c("_ak"), "left_semi")


# ----------------------------------------------------------------- onboarding

def scn_01(src: Sources, as_of, min_days: int = 1, status: str = V.CONTRACT_ACTIVATED,
           product_pattern: str = V.PRODUCT_LINE_PATTERN, one_onboarding_row: bool = False) -> DataFrame:
    """S1 CSM assignment overdue. Grain: account × contract × onboarding row
    (the source grain, Q17). ``one_onboarding_row=True`` attaches at most one
    onboarding record per account (the greatest stage/status), so the output
    grows with contracts only."""
    a = src.account.filter(null_or_empty("customer_success_associate_c")
                           & c("active_product_lines_c").ilike(product_pattern) & not_deleted())
    k = src.contract.filter((c("status") == status) & older_than("customer_signed_date", as_of, min_days)
                            & not_deleted()).select(c("account_id").alias("_caid"),
                                                    "customer_signed_date")
    o = src.onboarding.select(c("account_c").alias("_oaid"), c("stage_c"), c("status_c"))
    if one_onboarding_row:
        o = (o.groupBy("_oaid").agg(F.max(F.struct("stage_c", "status_c")).alias("_o"))
             .select("_oaid", c("_o.stage_c").alias("stage_c"), c("_o.status_c").alias("status_c")))
    j = a.join(k, c("_caid") == c("id")).join(o, c("_oaid") == c("id"), "left")
    return j.select(
        c("name").alias("account_name"), c("id").alias("sfdc_account_id"),
        c("type").alias("account_type"), c("active_product_lines_c").alias("product_lines"),
        c("customer_signed_date").alias("contract_signed_date"),
        day_diff("customer_signed_date", as_of).alias("days_since_signature"),
        c("customer_success_associate_c").alias("csm_assigned"),
        c("stage_c").alias("onboarding_stage"), c("status_c").alias("onboarding_status"))


def scn_02(src: Sources, as_of, min_days: int = 2, tel: Telemetry | None = None) -> DataFrame:
    """S2 license key provisioned, never used. Grain: license key."""
    k = _open_keys(src, tel).filter(c("lastvalidateddate").isNull()
                                    & older_than("dateassigned", as_of, min_days) & not_deleted())
    cu = _live_customers(src).select("customerid", "customername", "salesforceid")
    j = k.join(cu, "customerid").join(_account_dims(src), c("salesforceid") == c("_aid"), "left")
    return j.select(
        c("customername").alias("account_name"), c("salesforceid").alias("sfdc_account_id"),
        "account_type", "product_lines", c("assigneduser").alias("assigned_user"),
        c("customeremail").alias("user_email"), c("dateassigned").alias("key_assigned_date"),
        day_diff("dateassigned", as_of).alias("days_since_assigned"), "csm_id")


def scn_03(src: Sources, home_event: str = V.RC_HOME, tel: Telemetry | None = None,
           require_active_license_days: int | None = None, as_of=None) -> DataFrame:
    """S3 logs in but never reached the RC home page. Grain: telemetry account.
    ``require_active_license_days`` (with ``as_of``) applies the description's
    validated-license condition."""
    if tel is not None and tel.login is not None:  # a row per account and day
        log, days = tel.login, F.count("date")
    else:
        log, days = src.login, F.count_distinct("date")
    logins = log.groupBy("account_id").agg(F.max("date").alias("last_login_date"), days.alias("total_login_days"))
    if tel is not None and home_event == V.RC_HOME:
        did = tel.rc.filter(c("rc_home") == 1).select(c("account_id").alias("_did"))
        out = logins.join(did, c("account_id") == c("_did"), "left_anti")
    else:
        out = never_did(logins, "account_id", src.rc_events.filter(named(home_event)), "account_id")
    out = out.select(c("account_id").alias("telemetry_account_id"), "last_login_date",
                     "total_login_days", F.lit(0).alias("ever_reached_rc"))
    return _with_active_license(out, src, as_of, require_active_license_days)


def _rc_flags(src: Sources, flags: dict[str, str], key_alias: str = "_rk",
              tel: Telemetry | None = None) -> DataFrame:
    """Per telemetry account: one 0/1 flag per named RC event."""
    if tel is not None:
        return tel.rc.select(c("account_id").alias(key_alias), *flags)
    names = list(flags.values())
    m = milestones(src.rc_events.filter(c("tracked_event_name").isin(names)), "account_id",
                   {col: ever(named(n)) for col, n in flags.items()})
    return m.withColumnRenamed("account_id", key_alias)


def scn_04(src: Sources, as_of, min_days: int = 3, tel: Telemetry | None = None) -> DataFrame:
    """S4 first product use > N days ago, upload page never reached. Grain: licensing customer."""
    use = _customer_use(src, tel).select(
        "customerid", c("first_use").alias("first_product_use"), c("last_use").alias("last_product_use"))
    use = use.filter(older_than("first_product_use", as_of, min_days))
    rc = _rc_flags(src, {"clicked_upload": V.RC_UPLOAD_CLICKED,
                         "reached_upload_page": V.RC_UPLOAD_PAGE}, tel=tel)
    cu = _live_customers(src)
    j = (cu.join(use, "customerid")
         .join(rc, telemetry_key("webid") == c("_rk"), "left")
         .join(_account_dims(src), c("salesforceid") == c("_aid"), "left"))
    out = j.select(
        c("customerid").alias("licensing_customer_id"), c("customername").alias("account_name"),
        c("salesforceid").alias("sfdc_account_id"), "account_type", "product_lines",
        "first_product_use", "last_product_use",
        day_diff("first_product_use", as_of).alias("days_since_first_use"),
        F.coalesce("clicked_upload", F.lit(0)).alias("clicked_upload"),
        F.coalesce("reached_upload_page", F.lit(0)).alias("reached_upload_page"))
    return out.filter(c("reached_upload_page") == 0)


# ------------------------------------------------------------------ adoption

def scn_05(src: Sources, min_active_days: int = 30, tel: Telemetry | None = None) -> DataFrame:
    """S5 ≥ N active days, none of three secondary features used. Grain: licensing customer."""
    use = _customer_use(src, tel).select(
        "customerid", "active_days", F.datediff("last_use", "first_use").alias("active_span_days"))
    use = use.filter(c("active_days") >= min_active_days)
    rc = _rc_flags(src, {"used_lineos": V.RC_LINEOS, "used_view_all": V.RC_VIEW_ALL,
                         "used_schedule": V.RC_SCHEDULE_PAGE}, tel=tel)
    j = (_live_customers(src).join(use, "customerid")
         .join(rc, telemetry_key("webid") == c("_rk"), "left")
         .join(_account_dims(src), c("salesforceid") == c("_aid"), "left"))
    out = j.select(
        c("customerid").alias("licensing_customer_id"), c("customername").alias("account_name"),
        c("salesforceid").alias("sfdc_account_id"), "account_type", "product_lines",
        "active_days", "active_span_days",
        *[F.coalesce(f, F.lit(0)).alias(f) for f in ("used_lineos", "used_view_all", "used_schedule")],
        "csm_id")
    return out.filter((c("used_lineos") == 0) & (c("used_view_all") == 0) & (c("used_schedule") == 0))


def scn_06(src: Sources, as_of, min_days: int = 5, tel: Telemetry | None = None) -> DataFrame:
    """S6 schedule creation started, never completed. Grain: telemetry account."""
    if tel is not None:
        m = tel.rc.select("account_id", c("first_schedule_page_visit").alias("first_start"),
                          c("last_schedule_page_visit").alias("last_start"),
                          c("schedule_page_visits").alias("starts"),
                          c("completed_schedule").alias("completed"))
        m = m.withColumn("days_since_first_start", day_diff("first_start", as_of)).filter(
            c("first_start").isNotNull() & (c("completed") == 0) & (c("days_since_first_start") > min_days))
    else:
        m = started_not_completed(src.rc_events, "account_id", named(V.RC_SCHEDULE_PAGE),
                                  named(V.RC_SCHEDULE_CREATED), event_date(), as_of, min_days)
    return m.select(c("account_id").alias("telemetry_account_id"),
                    c("first_start").alias("first_schedule_page_visit"),
                    c("last_start").alias("last_schedule_page_visit"),
                    c("starts").alias("schedule_page_visits"),
                    c("completed").alias("completed_schedule"),
                    c("days_since_first_start").alias("days_since_first_visit"))


def scn_07(src: Sources, as_of, min_days: int = 7, tel: Telemetry | None = None,
           require_active_license_days: int | None = None) -> DataFrame:
    """S7 active in RC for N+ days, no IL event ever. Grain: telemetry account."""
    d = event_date()
    if tel is not None:
        m = tel.rc.select("account_id", "first_rc_event", "last_rc_event", "distinct_rc_events")
    else:
        m = milestones(src.rc_events, "account_id", {
            "first_rc_event": first(None, d), "last_rc_event": last(None, d),
            "distinct_rc_events": distinct()}, distinct_col="tracked_event_name")
    m = m.withColumn("days_in_rc", day_diff("first_rc_event", as_of)).filter(c("days_in_rc") >= min_days)
    if tel is not None:
        did = tel.il.filter(c("il_named") == 1).select(c("account_id").alias("_did"))
        out = m.join(did, c("account_id") == c("_did"), "left_anti")
    else:
        out = never_did(m, "account_id", src.il_events, "account_id")
    out = out.select(c("account_id").alias("telemetry_account_id"), "first_rc_event",
                     "last_rc_event", "distinct_rc_events", "days_in_rc",
                     F.lit(0).cast("long").alias("total_il_events"))
    return _with_active_license(out, src, as_of, require_active_license_days)


_S8_COLS = ["visited_il_home", "clicked_il_button", "started_rule", "added_subscriber", "saved_rule",
            "viewed_results_only", "total_il_sessions"]


def scn_08(src: Sources, tel: Telemetry | None = None) -> DataFrame:
    """S8 rule funnel: IL home visited, rule never saved. Grain: telemetry account."""
    if tel is not None:
        m = tel.il.select("account_id", *_S8_COLS)
        return (m.filter((c("visited_il_home") == 1) & (c("saved_rule") == 0))
                .withColumnRenamed("account_id", "telemetry_account_id"))
    m = started_not_completed(src.il_events, "account_id", named(V.IL_HOME), named(V.IL_SAVE_RULE), event_date(), extra={
        "clicked_il_button": ever(named(V.IL_BUTTON)),
        "started_rule": ever(named(V.IL_CREATE_RULE)),
        "added_subscriber": ever(named(V.IL_SUBSCRIBERS)),
        "viewed_results_only": ever(named(V.IL_RESULTS)),
        "total_il_sessions": distinct()}, distinct_col="session_id")
    return m.select(c("account_id").alias("telemetry_account_id"), F.lit(1).alias("visited_il_home"), "clicked_il_button",
                    "started_rule", "added_subscriber", c("completed").alias("saved_rule"), "viewed_results_only",
                    "total_il_sessions")


def scn_09(src: Sources, as_of, min_days: int = 7, tel: Telemetry | None = None) -> DataFrame:
    """S9 rule saved, results never viewed, first save > N days ago. Grain: telemetry account."""
    save, results, d = named(V.IL_SAVE_RULE), named(V.IL_RESULTS), event_date()
    if tel is not None:
        m = tel.il.select("account_id", "first_rule_saved_date", "last_rule_saved_date",
                          c("rule_save_events").alias("total_rules_saved"), "last_results_view")
    else:
        # A results view counts from its day: one without a readable day does not.
        m = started_not_completed(src.il_events, "account_id", save, results & d.isNotNull(), d, as_of, min_days)
        return m.select(c("account_id").alias("telemetry_account_id"), c("first_start").alias("first_rule_saved_date"),
                        c("last_start").alias("last_rule_saved_date"), c("starts").alias("total_rules_saved"),
                        F.lit(None).cast("date").alias("last_results_view"),
                        c("days_since_first_start").alias("days_since_first_rule"))
    m = m.withColumn("days_since_first_rule", day_diff("first_rule_saved_date", as_of))
    return (m.filter(c("first_rule_saved_date").isNotNull() & c("last_results_view").isNull()
                     & (c("days_since_first_rule") > min_days))
            .withColumnRenamed("account_id", "telemetry_account_id"))


# ----------------------------------------------------------------- retention

def scn_10(src: Sources, ref_date=None, window_days: int = 30, min_prev_users: int = 5,
           max_ratio: float = 0.5, exclusive: bool = False, tel: Telemetry | None = None) -> DataFrame:
    """S10 seat utilisation drop: current-window users < ratio × previous.

    ``ref_date`` defaults to the latest usage day, a scalar subquery over the
    partition column where the log is stored by day (over the time otherwise).
    Both windows bound the partition column too, so only their days are read.
    """
    if ref_date is not None:
        ref = as_date(ref_date)
    elif tel is not None and tel.usage is not None:
        ref = feed_as_of(tel.usage, "usage_day")
    else:
        ref = feed_as_of(src.license_usage, src.day_partitions.get("license_usage", ("", "lastvalidateddate"))[1])
    usage, _ = _usage_since(src, tel, ref, 2 * window_days)
    u = window_retention(usage, "customerid", "assigneduser", "lastvalidateddate", ref, window_days, exclusive)
    u = u.filter((c("prev") >= min_prev_users) & (ratio("curr", "prev") < max_ratio))
    j = (u.join(_live_customers(src), "customerid")
         .join(_account_dims(src), c("salesforceid") == c("_aid"), "left"))
    return j.select(
        c("customerid").alias("licensing_customer_id"), c("customername").alias("account_name"),
        c("salesforceid").alias("sfdc_account_id"), "account_type", "product_lines",
        c("prev").alias("active_users_prev_30d"), c("curr").alias("active_users_curr_30d"),
        pct("curr", "prev").alias("utilization_retention_pct"),
        c("next_renewal_date_c").alias("next_renewal_date"),
        c("open_renewable_amount_c").alias("arr_at_risk"), "csm_id")


def _renewing_accounts(src: Sources, as_of, renewal_days: int,
                       product_pattern: str | None = None) -> DataFrame:
    p = due_within("next_renewal_date_c", as_of, renewal_days) & not_deleted()
    if product_pattern is not None:
        p = p & c("active_product_lines_c").ilike(product_pattern)
    return src.account.filter(p)


def scn_11(src: Sources, as_of, idle_days: int = 30, renewal_days: int = 120,
           min_pct: float = 30, tel: Telemetry | None = None) -> DataFrame:
    """S11 dormant licensed seats before renewal. Grain: (customer name, CRM account)."""
    acct = _renewing_accounts(src, as_of, renewal_days)
    cust = semi(_live_customers(src), key_set(acct, "id"), "salesforceid").select(
        "customerid", "customername", "salesforceid")
    keys = _open_keys(src, tel).filter(not_deleted()).join(cust, "customerid")
    seats = dormancy(keys, ["customername", "salesforceid"], "assigneduser", "lastvalidateddate",
                     as_of, idle_days)
    seats = seats.withColumn("dormancy_pct", pct("dormant", "total")).filter(c("dormancy_pct") > min_pct)
    j = seats.join(acct, c("salesforceid") == c("id"))
    return j.select(
        c("customername").alias("account_name"), c("salesforceid").alias("sfdc_account_id"),
        c("type").alias("account_type"), c("active_product_lines_c").alias("product_lines"),
        c("next_renewal_date_c").alias("next_renewal_date"),
        day_diff(as_date(as_of), "next_renewal_date_c").alias("days_to_renewal"),
        c("open_renewable_amount_c").alias("arr_at_risk"),
        c("total").alias("total_registered_seats"), c("dormant").alias("dormant_seats"),
        "dormancy_pct", c("customer_success_associate_c").alias("csm_id"))


def scn_12(src: Sources, as_of, window_days: int = 14, only_alerts: bool = True,
           tel: Telemetry | None = None, require_active_license_days: int | None = None) -> DataFrame:
    """S12 logins in the window without any IL event in it. Grain: telemetry account.

    ``only_alerts=False`` keeps every account that logged in, with its true IL
    event count and the three-way health signal.
    """
    logins = (_logins_since(src, tel, as_of, window_days)
              .groupBy("account_id").agg(F.count_distinct("date").alias("login_days_14d"),
                                         F.max("date").alias("last_login_date"))
              .filter(c("login_days_14d") > 0))
    lo = F.date_sub(as_date(as_of), window_days)
    il_recent = src.il_events.filter(c("tracked_event_name").isNotNull() & (event_date() >= lo))
    if "il_events" in src.day_partitions:     # stored by parsed event day: prune partitions
        il_recent = il_recent.filter(c(src.day_partitions["il_events"][1]) >= lo)
    if only_alerts and tel is not None:
        did = tel.il.filter(c("last_named_il_event") >= F.date_sub(as_date(as_of), window_days)) \
            .select(c("account_id").alias("_did"))
        out = logins.join(did, c("account_id") == c("_did"), "left_anti") \
            .withColumn("il_events_14d", F.lit(0).cast("long"))
    elif only_alerts:
        out = never_did(logins, "account_id", il_recent, "account_id")
        out = out.withColumn("il_events_14d", F.lit(0).cast("long"))
    else:
        n = il_recent.groupBy(c("account_id").alias("_ik")).agg(F.count("*").alias("_n"))
        out = (logins.join(n, c("account_id") == c("_ik"), "left")
               .withColumn("il_events_14d", F.coalesce("_n", F.lit(0)).cast("long")))
    signal = tier([(c("il_events_14d") == 0, V.SIGNAL_LOGIN_ONLY),
                   (c("il_events_14d") < 3, V.SIGNAL_LOW_IL)], V.SIGNAL_HEALTHY)
    out = out.select(c("account_id").alias("telemetry_account_id"), "login_days_14d",
                     "il_events_14d", signal.alias("health_signal"), "last_login_date")
    return _with_active_license(out, src, as_of, require_active_license_days)


def scn_13(src: Sources, as_of, save_idle_days: int = 60, idle_days: int = 14,
           tel: Telemetry | None = None, spec_semantics: bool = False) -> DataFrame:
    """S13 IL engagement drop. Grain: telemetry account.

    Trigger as coded in the source: last save older than ``save_idle_days``,
    OR results never viewed and no IL event for ``idle_days``.
    """
    d = event_date()
    save = named(V.IL_SAVE_RULE)
    if tel is not None:
        m = tel.il.select("account_id", c("last_rule_saved_date").alias("last_rule_save"),
                          "last_results_view", "last_rule_edit",
                          c("save_sessions").alias("total_rules_saved"),
                          c("delete_sessions").alias("rules_deleted"), c("last_il_event").alias("_last_any"))
    else:
        m = milestones(src.il_events, "account_id", {
            "last_rule_save": last(save, d),
            "last_results_view": last(named(V.IL_RESULTS), d),
            "last_rule_edit": last(named(V.IL_EDIT_RULE), d),
            "total_rules_saved": distinct(save),
            "rules_deleted": distinct(named(V.IL_DELETE_RULE)),
            "_last_any": last(None, d)}, distinct_col="session_id")
    m = m.withColumn("days_since_any_il_event", day_diff("_last_any", as_of))
    stale_save = c("last_rule_save").isNotNull() & (day_diff("last_rule_save", as_of) > save_idle_days)
    if spec_semantics:   # the description: results not viewed in the last ``idle_days``
        trig = stale_save | c("last_results_view").isNull() | (day_diff("last_results_view", as_of) > idle_days)
    else:                # the SQL: never viewed and no IL event for ``idle_days``
        trig = stale_save | (c("last_results_view").isNull() & (c("days_since_any_il_event") > idle_days))
    return m.filter(trig).select(c("account_id").alias("telemetry_account_id"), "last_rule_save",
                                 "last_results_view", "last_rule_edit", "total_rules_saved",
                                 "rules_deleted", "days_since_any_il_event")


def scn_14(src: Sources, as_of, renewal_days: int = 120, login_days: int = 90,
           usage_days: int = 30, idle_days: int = 30, max_cases: int = 5,
           product_pattern: str = V.PRODUCT_LINE_PATTERN, tel: Telemetry | None = None) -> DataFrame:
    """S14 pre-renewal health scorecard. Grain: CRM account.

    Four signals, each pre-aggregated at account grain over the candidate
    accounts only. Distinct users are counted after mapping customers to the
    account, so a user licensed under two customers of one account counts once.
    """
    acct = _renewing_accounts(src, as_of, renewal_days, product_pattern)
    acct = acct.withColumn("_tk", telemetry_key("platform_legacy_id_c"))
    tkeys, ids = key_set(acct, "_tk"), key_set(acct, "id")
    login = (_logins_since(src, tel, as_of, login_days)
             .transform(lambda d: semi(d, tkeys, "account_id"))
             .groupBy(c("account_id").alias("_lk"))
             .agg(F.count_distinct("date").alias("login_days_90d")))
    if tel is not None:
        il = tel.il.select(c("account_id").alias("_ik"), c("total_il_sessions").alias("il_sessions_all_time"))
    else:
        il = (semi(src.il_events, tkeys, "account_id")
              .groupBy(c("account_id").alias("_ik"))
              .agg(F.count_distinct("session_id").alias("il_sessions_all_time")))
    cust = semi(src.license_customer, ids, "salesforceid").select("customerid", "salesforceid")
    seats, _ = _usage_since(src, tel, as_of, usage_days)
    users = (seats.select("customerid", "assigneduser").distinct().join(cust, "customerid")
             .groupBy(c("salesforceid").alias("_uk"))
             .agg(F.count_distinct("assigneduser").alias("active_licensed_users_30d")))
    keys = _open_keys(src, tel).join(cust, "customerid")
    dormant = (dormancy(keys, "salesforceid", "assigneduser", "lastvalidateddate", as_of, idle_days)
               .select(c("salesforceid").alias("_dk"), c("dormant").alias("dormant_seats")))
    j = (acct.join(login, c("_tk") == c("_lk"), "left")
         .join(il, c("_tk") == c("_ik"), "left")
         .join(users, c("id") == c("_uk"), "left")
         .join(dormant, c("id") == c("_dk"), "left"))
    health = c("totango_totango_account_health_c")
    risk = tier([(health == V.HEALTH_POOR, V.TIER_RED),
                 ((health == V.HEALTH_AVERAGE) | (c("open_support_cases_c") > max_cases), V.TIER_AMBER)],
                V.TIER_GREEN)
    zero = F.lit(0).cast("long")
    return j.select(
        c("name").alias("account_name"), c("id").alias("sfdc_account_id"),
        c("type").alias("account_type"), c("active_product_lines_c").alias("product_lines"),
        c("next_renewal_date_c").alias("renewal_date"),
        day_diff(as_date(as_of), "next_renewal_date_c").alias("days_to_renewal"),
        c("open_renewable_amount_c").alias("arr"), c("customer_health_grade_c").alias("health_grade"),
        health.alias("totango_health"), c("at_risk_c").alias("at_risk_flag"),
        c("open_support_cases_c").alias("open_cases"),
        c("customer_success_associate_c").alias("csm_id"),
        *[F.coalesce(x, zero).alias(x) for x in ("login_days_90d", "il_sessions_all_time",
                                                   "active_licensed_users_30d", "dormant_seats")],
        risk.alias("risk_tier"))


# --------------------------------------------------------------- offboarding

def scn_15(src: Sources, as_of, window_days: int = 30, tel: Telemetry | None = None) -> DataFrame:
    """S15 maintenance lapsed, product still used. Grain: licensing customer."""
    cu = _live_customers(src).filter(c("onmaintenance") == F.lit(False))
    usage, last_ts = _usage_since(src, tel, as_of, window_days)
    use = (active_rollup(semi(usage, key_set(cu, "customerid"), "customerid"), "customerid", "lastvalidateddate",
                         entity="assigneduser", last_ts=last_ts)
           .select("customerid", c("last_use").alias("last_license_validation"),
                   c("entities").alias("users_still_active")))
    j = cu.join(use, "customerid").join(_account_dims(src), c("salesforceid") == c("_aid"), "left")
    return j.select(
        c("customerid").alias("licensing_customer_id"), c("customername").alias("account_name"),
        c("salesforceid").alias("sfdc_account_id"), "account_type", "product_lines",
        c("onmaintenance").alias("on_maintenance"), "last_license_validation",
        day_diff("last_license_validation", as_of).alias("days_since_last_use"),
        "users_still_active", c("contract_status_c").alias("sfdc_contract_status"),
        c("cancellation_date_c").alias("cancellation_date"),
        c("next_renewal_date_c").alias("next_renewal_date"))


def scn_16(src: Sources, product_line: str = V.PRODUCT_LINE,
           stage: str = V.STAGE_CLOSED_LOST, tel: Telemetry | None = None,
           as_of_close: bool = False) -> DataFrame:
    """S16 closed-lost opportunity audit. Grain: opportunity.

    ``as_of_close=True`` bounds every fact by the opportunity's close day (the
    description's "at churn"; the source SQL does not, Q27)."""
    opp = src.opportunity.filter((c("product_line_c") == product_line) & (c("stage_name") == stage)
                                 & not_deleted())
    acct = src.account.filter(not_deleted()).withColumn("_tk", telemetry_key("platform_legacy_id_c"))
    base = opp.select(c("id").alias("opportunity_id"), c("account_id").alias("_oa"), "close_date",
                      "win_loss_reason_c", "win_loss_sub_reason_c").join(acct, c("_oa") == c("id"))
    tkeys, ids = key_set(base, "_tk"), key_set(base, "id")
    if as_of_close:
        return _s16_at_close(src, base, tkeys, ids)
    if tel is not None:
        il = tel.il.select(c("account_id").alias("_ik"),
                           c("il_named").alias("ever_used_intelligence_layer"),
                           c("saved_rule").alias("ever_saved_rule"))
        rc = tel.rc.select(c("account_id").alias("_rk"),
                           c("reached_upload_page").alias("ever_uploaded_report"))
    else:
        il = milestones(semi(src.il_events, tkeys, "account_id"),
                        "account_id", {"ever_used_intelligence_layer": ever(c("tracked_event_name").isNotNull()),
                                       "ever_saved_rule": ever(named(V.IL_SAVE_RULE))})
        il = il.withColumnRenamed("account_id", "_ik")
        rc = (keys_that(semi(src.rc_events, tkeys, "account_id"),
                        "account_id", named(V.RC_UPLOAD_PAGE))
              .select(c("account_id").alias("_rk"), F.lit(1).alias("ever_uploaded_report")))
    cust = semi(src.license_customer, ids, "salesforceid").select("customerid", "salesforceid")
    usage, last_ts = _usage(src, tel)
    # A profile's rows are a seat's days already and meet their customer as they are.
    seats = (usage.groupBy("customerid", "assigneduser").agg(F.max(last_ts).alias("last_ts"))
             if last_ts != "last_ts" else usage.select("customerid", "assigneduser", "last_ts"))
    use = (seats.join(cust, "customerid")
           .groupBy(c("salesforceid").alias("_uk"))
           .agg(F.max("last_ts").alias("last_license_use_date"),
                F.count_distinct("assigneduser").alias("users_at_churn")))
    j = (base.join(il, c("_tk") == c("_ik"), "left").join(rc, c("_tk") == c("_rk"), "left")
         .join(use, c("id") == c("_uk"), "left"))
    zero = F.lit(0)
    return j.select(
        "opportunity_id", c("name").alias("account_name"), c("id").alias("sfdc_account_id"),
        c("type").alias("account_type"), c("active_product_lines_c").alias("product_lines"),
        c("close_date").alias("closed_lost_date"), c("win_loss_reason_c").alias("loss_reason"),
        c("win_loss_sub_reason_c").alias("loss_sub_reason"),
        *[F.coalesce(x, zero).alias(x) for x in ("ever_used_intelligence_layer", "ever_saved_rule",
                                                   "ever_uploaded_report")],
        "last_license_use_date",
        F.coalesce("users_at_churn", zero.cast("long")).alias("users_at_churn"))


def _s16_at_close(src: Sources, base: DataFrame, tkeys: DataFrame, ids: DataFrame) -> DataFrame:
    """S16 with facts on or before each opportunity's close day.

    Ever-flags compare the account's *first* occurrence with the close day;
    users and last use come from ``running_by_day`` over per-(account, day)
    reductions — an as-of lookup that never pairs opportunities with rows.
    """
    d = event_date()
    il = milestones(semi(src.il_events, tkeys, "account_id"), "account_id", {
        "_first_il": first(c("tracked_event_name").isNotNull(), d),
        "_first_save": first(named(V.IL_SAVE_RULE), d)}).withColumnRenamed("account_id", "_ik")
    rc = milestones(semi(src.rc_events, tkeys, "account_id"), "account_id", {
        "_first_upload": first(named(V.RC_UPLOAD_PAGE), d)}).withColumnRenamed("account_id", "_rk")
    cust = semi(src.license_customer, ids, "salesforceid").select("customerid", "salesforceid")
    use = (src.license_usage.withColumn("day", c("lastvalidateddate").cast("date"))
           .groupBy("customerid", "assigneduser", "day").agg(F.max("lastvalidateddate").alias("lastvalidateddate"))
           .join(cust, "customerid"))
    new_users = (use.groupBy("salesforceid", "assigneduser").agg(F.min("day").alias("day"))
                 .filter(c("assigneduser").isNotNull())
                 .groupBy("salesforceid", "day").agg(F.count(F.lit(1)).alias("users")))
    last_use = use.groupBy("salesforceid", "day").agg(F.max("lastvalidateddate").alias("last_use"))
    facts = (new_users.select("salesforceid", "day", "users", F.lit(None).cast("timestamp_ntz").alias("last_use"))
             .unionByName(last_use.select("salesforceid", "day", F.lit(None).cast("long").alias("users"),
                                          "last_use")))
    probes = base.select(c("id").alias("salesforceid"), c("close_date").alias("day"))
    run = running_by_day(facts, probes, "salesforceid", "day", sums=["users"], maxes=["last_use"])
    run = run.select(c("salesforceid").alias("_uk"), c("day").alias("_ud"), "users", "last_use")
    j = (base.join(il, c("_tk") == c("_ik"), "left").join(rc, c("_tk") == c("_rk"), "left")
         .join(run, (c("id") == c("_uk")) & (c("close_date") == c("_ud")), "left"))
    by_close = lambda x: F.coalesce((c(x) <= c("close_date")).cast("int"), F.lit(0))
    return j.select(
        "opportunity_id", c("name").alias("account_name"), c("id").alias("sfdc_account_id"),
        c("type").alias("account_type"), c("active_product_lines_c").alias("product_lines"),
        c("close_date").alias("closed_lost_date"), c("win_loss_reason_c").alias("loss_reason"),
        c("win_loss_sub_reason_c").alias("loss_sub_reason"),
        by_close("_first_il").alias("ever_used_intelligence_layer"),
        by_close("_first_save").alias("ever_saved_rule"),
        by_close("_first_upload").alias("ever_uploaded_report"),
        c("last_use").alias("last_license_use_date"),
        F.coalesce("users", F.lit(0).cast("long")).alias("users_at_churn"))


SCENARIOS = {
    "S1": scn_01, "S2": scn_02, "S3": scn_03, "S4": scn_04, "S5": scn_05, "S6": scn_06,
    "S7": scn_07, "S8": scn_08, "S9": scn_09, "S10": scn_10, "S11": scn_11, "S12": scn_12,
    "S13": scn_13, "S14": scn_14, "S15": scn_15, "S16": scn_16,
}
