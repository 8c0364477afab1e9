"""Master account view and reports (MST-01..06, RPT-01..04).

Scenario membership is collected in long form — (sfdc_account_id, scenario)
— and turned into sixteen flags with a single ``groupBy``, so the master view
is one join of the account table to one flag table instead of sixteen outer
joins. Telemetry-grain scenarios reach the CRM id through the bridge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.dates import as_date, day_diff
from tidemark.functions.predicates import flag_sum, not_deleted
from tidemark.operators.bridge import telemetry_bridge
from tidemark.sources.registry import Sources

c = F.col


def latest_contract(src: Sources, status: str = V.CONTRACT_ACTIVATED) -> DataFrame:
    """WIN-01 / MST-05: latest live contract per account with ``status``.

    Order: signed date descending with NULL first (the source engine sorts
    NULL high), then contract id descending as a stable tie-break. Catalyst
    plans ``rn = 1`` as a WindowGroupLimit, which keeps only each task's
    top row per account before the shuffle.
    """
    w = Window.partitionBy("account_id").orderBy(c("customer_signed_date").desc_nulls_first(),
                                                 c("contract_id").desc_nulls_last())
    k = src.contract.filter((c("status") == status) & not_deleted())
    return (k.withColumn("rn", F.row_number().over(w)).filter(c("rn") == 1)
            .select("account_id", "contract_id", "status", "customer_signed_date"))


def membership_rows(frames: dict[str, DataFrame], bridge: DataFrame) -> DataFrame:
    """(sfdc_account_id, scenario) per mart row, duplicates kept — enough for
    flag aggregation, which is duplicate-insensitive (one shuffle less). All
    telemetry-grain marts pass the bridge together, in one join."""
    b = bridge.select(c("telemetry_account_id").alias("_tk"), c("sfdc_account_id").alias("_sid"))
    parts = [df.select("sfdc_account_id", F.lit(sid).alias("scenario"))
             for sid, df in frames.items() if sid not in V.TELEMETRY_GRAIN]
    tele = [df.select("telemetry_account_id", F.lit(sid).alias("scenario"))
            for sid, df in frames.items() if sid in V.TELEMETRY_GRAIN]
    if tele:
        parts.append(reduce(DataFrame.unionByName, tele).join(b, c("telemetry_account_id") == c("_tk"))
                     .select(c("_sid").alias("sfdc_account_id"), "scenario"))
    if not parts:
        return bridge.sparkSession.createDataFrame([], "sfdc_account_id string, scenario string")
    return reduce(DataFrame.unionByName, parts).filter(c("sfdc_account_id").isNotNull())


def memberships(frames: dict[str, DataFrame], bridge: DataFrame) -> DataFrame:
    """Long form (sfdc_account_id, scenario), one row per account and scenario."""
    return membership_rows(frames, bridge).distinct()


def scenario_flags(members: DataFrame, scenario_ids=V.SCENARIO_IDS) -> DataFrame:
    """One row per account, one boolean per scenario (pivot on a fixed list)."""
    return members.groupBy(c("sfdc_account_id").alias("_fid")).agg(
        *[F.max(c("scenario") == sid).alias(V.MASTER_FLAGS[sid]) for sid in scenario_ids])


def master_account(src: Sources, frames: dict[str, DataFrame], as_of,
                   product_pattern: str = V.PRODUCT_LINE_PATTERN,
                   one_row_per_account: bool = False) -> DataFrame:
    """MST-01: one row per (live, in-product) account × live licensing customer.

    As in the source, an account with several licensing customers appears
    once per customer. With
    ``one_row_per_account`` the lowest customer id represents the account and
    a ``licensing_customers`` column counts them (Q21).
    """
    acct = src.account.filter(c("active_product_lines_c").ilike(product_pattern) & not_deleted())
    users = src.user.filter(not_deleted()).select(c("id").alias("_uid"), c("name").alias("csm_name"),
                                                  c("email").alias("csm_email"))
    contract = latest_contract(src).select(c("account_id").alias("_kid"),
                                           c("status").alias("contract_status"),
                                           c("customer_signed_date").alias("contract_signed_date"))
    cust = src.license_customer.filter(not_deleted()).select(
        c("salesforceid").alias("_lid"), c("customerid").alias("licensing_customer_id"),
        c("webid").alias("platform_web_id"))
    if one_row_per_account:
        cust = cust.groupBy("_lid").agg(
            F.min("licensing_customer_id").alias("licensing_customer_id"),
            F.min_by("platform_web_id", "licensing_customer_id").alias("platform_web_id"),
            F.count(F.lit(1)).alias("licensing_customers"))
    flags = scenario_flags(membership_rows(frames, telemetry_bridge(src, ("webid",))))
    j = (acct.join(users, c("_uid") == c("customer_success_associate_c"), "left")
         .join(contract, c("_kid") == c("id"), "left")
         .join(cust, c("_lid") == c("id"), "left")
         .join(flags, c("_fid") == c("id"), "left"))
    flag_cols = [V.MASTER_FLAGS[s] for s in V.SCENARIO_IDS]
    return j.select(
        c("name").alias("account_name"), c("id").alias("sfdc_account_id"),
        c("type").alias("account_type"), c("channel_type__c").alias("channel"),
        c("active_product_lines_c").alias("product_lines"),
        c("customer_success_associate_c").alias("csm_id"), "csm_name", "csm_email",
        "contract_status", "contract_signed_date",
        c("next_renewal_date_c").alias("next_renewal_date"),
        day_diff(as_date(as_of), "next_renewal_date_c").alias("days_to_renewal"),
        c("open_renewable_amount_c").alias("arr"), c("at_risk_c").alias("at_risk_flag"),
        c("customer_health_grade_c").alias("health_grade"),
        c("totango_totango_account_health_c").alias("totango_health"),
        c("open_support_cases_c").alias("open_support_cases"),
        "licensing_customer_id", "platform_web_id",
        *[F.coalesce(c(f), F.lit(False)).alias(f) for f in flag_cols],
        flag_sum([F.coalesce(c(f), F.lit(False)) for f in flag_cols]).alias("active_scenario_count"),
        *([F.coalesce("licensing_customers", F.lit(0).cast("long")).alias("licensing_customers")]
          if one_row_per_account else []))


def scenario_order(col: str = "scenario") -> F.Column:
    """SRT-05: numeric order of scenario labels (S1, S2, …, S16, MASTER) —
    a text sort would put S10 before S2."""
    labels = V.SCENARIO_IDS + ["MASTER"]
    rank = F.create_map(*[x for i, sid in enumerate(labels) for x in (F.lit(sid), F.lit(i))])
    return rank[c(col)]


def mart_counts(frames: dict[str, DataFrame], master: DataFrame | None = None) -> DataFrame:
    """RPT-01: (scenario, rows) for every mart, zero-row marts included."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(sid).alias("scenario"), "rows")
             for sid, df in frames.items()]
    if master is not None:
        parts.append(master.agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit("MASTER").alias("scenario"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def alerts_by_stage(frames: dict[str, DataFrame], bridge: DataFrame) -> DataFrame:
    """RPT-02: alert rows and distinct CRM accounts per stage and scenario,
    with stage subtotals and a grand total (``rollup``).

    Each mart is read once: its rows are reduced to (scenario, key, n) — one
    shuffle, partial on the map side — and that result feeds both the row
    counts and, through the bridge for telemetry-grain marts, the accounts.
    """
    keyed = reduce(DataFrame.unionByName, [
        df.select(F.lit(sid).alias("scenario"),
                  c("telemetry_account_id" if sid in V.TELEMETRY_GRAIN else "sfdc_account_id").alias("key"))
        for sid, df in frames.items()])
    per_key = keyed.groupBy("scenario", "key").agg(F.count(F.lit(1)).alias("n"))
    tele = F.col("scenario").isin(*V.TELEMETRY_GRAIN)
    b = bridge.select(c("telemetry_account_id").alias("_tk"), c("sfdc_account_id").alias("_sid"))
    rows = per_key.select("scenario", F.lit(None).cast("string").alias("sfdc_account_id"),
                          c("n").alias("is_row"))
    crm = per_key.filter(~tele).select("scenario", c("key").alias("sfdc_account_id"),
                                       F.lit(0).cast("long").alias("is_row"))
    via_bridge = (per_key.filter(tele).join(b, c("key") == c("_tk"))
                  .select("scenario", c("_sid").alias("sfdc_account_id"), F.lit(0).cast("long").alias("is_row")))
    stage = F.create_map(*[x for sid in V.SCENARIO_IDS for x in (F.lit(sid), F.lit(V.STAGE_OF[sid]))])
    long = rows.unionByName(crm).unionByName(via_bridge).withColumn("stage", stage[c("scenario")])
    return (long.rollup("stage", "scenario")
            .agg(F.sum("is_row").cast("long").alias("alert_rows"),
                 F.count_distinct("sfdc_account_id").alias("accounts")))


def alerts_by_owner(src: Sources, members: DataFrame) -> DataFrame:
    """RPT-02 tiles: accounts with an open alert per CSM and per product line,
    by scenario — (dimension, value, scenario, accounts). An account counts
    once per line it holds (lines are separated by ``;``)."""
    acct = src.account.filter(not_deleted()).select(
        "id", c("customer_success_associate_c").alias("csm"),
        F.array_distinct(F.filter(F.transform(F.split(F.lower("active_product_lines_c"), ";"), lambda x: F.trim(x)),
                                  lambda x: x != "")).alias("lines"))
    dims = F.array(F.struct(F.lit("csm").alias("dimension"), c("csm").alias("value")))
    lines = F.transform(F.coalesce("lines", F.array().cast("array<string>")),
                        lambda x: F.struct(F.lit("product_line").alias("dimension"), x.alias("value")))
    return (members.join(acct, c("sfdc_account_id") == c("id"))
            .select("scenario", F.explode(F.concat(dims, lines)).alias("d"))
            .groupBy("d.dimension", "d.value", "scenario").agg(F.count(F.lit(1)).alias("accounts")))


def csm_worklist(src: Sources, members: DataFrame, as_of,
                 product_pattern: str = V.PRODUCT_LINE_PATTERN) -> DataFrame:
    """RPT-04: every open alert with its account and CSM, one row per
    (account, scenario); filter and page it with ``publish.read_mart``."""
    acct = src.account.filter(c("active_product_lines_c").ilike(product_pattern) & not_deleted())
    users = src.user.filter(not_deleted()).select(c("id").alias("_uid"), c("name").alias("csm_name"))
    stage = F.create_map(*[x for sid in V.SCENARIO_IDS for x in (F.lit(sid), F.lit(V.STAGE_OF[sid]))])
    return (members.join(acct, c("sfdc_account_id") == c("id"))
            .join(users, c("_uid") == c("customer_success_associate_c"), "left")
            .select(c("customer_success_associate_c").alias("csm_id"), "csm_name", "sfdc_account_id",
                    c("name").alias("account_name"), c("active_product_lines_c").alias("product_lines"),
                    stage[c("scenario")].alias("stage"), "scenario",
                    day_diff(as_date(as_of), "next_renewal_date_c").alias("days_to_renewal")))


def enrich_telemetry(df: DataFrame, src: Sources, paths=("webid",)) -> DataFrame:
    """RPT-03: add CRM id, account type and product lines to a telemetry-grain
    mart through the bridge (one row per mart row × matched account)."""
    b = (telemetry_bridge(src, paths).select(c("telemetry_account_id").alias("_tk"),
                                             "sfdc_account_id").distinct())
    a = src.account.select(c("id").alias("_aid"), c("type").alias("account_type"),
                           c("active_product_lines_c").alias("product_lines"))
    return (df.join(b, c("telemetry_account_id") == c("_tk"), "left")
            .join(a, c("sfdc_account_id") == c("_aid"), "left").drop("_tk", "_aid"))
