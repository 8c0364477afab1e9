"""Query registry: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL.

Every query reads the driver's tables through the role mapping
(``tidemark.sources.testmap``), over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import scenarios as S
from tidemark.plans.refresh import default_builders, write_marts, write_profiles
from tidemark.publish import files
from tidemark.registry import oracle as Q
from tidemark.session import checkpoint_dir
from tidemark.sources.testmap import EVENTS_AS_OF as EV, ORDERS_AS_OF as OR, roles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = Q.with_roles(sql)
        return fn
    return deco


# S10's windows as in the source; ``scn_10_180d`` takes longer ones.
S10_WINDOW = 30

_BUILDERS = default_builders(OR, EV)


def scenario_frames(spark, src) -> dict[str, DataFrame]:
    """All sixteen marts for the test mapping, keyed S1..S16, built the way a
    refresh builds them: each log reduced once to a profile, each mart written
    once, in a fresh folder of the shared store, and read back. Runs jobs; only
    the marts stay."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-marts-{uuid.uuid4().hex}"
    tel = write_profiles(spark, src, f"{out}/_profiles")
    marts = write_marts(spark, src, default_builders(OR, EV, tel=tel), out)[0]
    files.delete(spark, f"{out}/_profiles")
    return marts


def scenario_sql(sid: str) -> str:
    return Q.s10_sql(S10_WINDOW) if sid == "S10" else Q.SCENARIO_SQL[sid]


def _scn_query(sid: str) -> QueryFn:
    return lambda spark, sf_dir: _BUILDERS[sid](roles(spark, sf_dir))


for _sid in _BUILDERS:
    register(f"scn_{int(_sid[1:]):02d}", scenario_sql(_sid))(_scn_query(_sid))


# ------------------------------------------------------------ master, reports

def _master_parts(spark, sf_dir, with_members: bool = False):
    from tidemark.operators.bridge import telemetry_bridge
    from tidemark.plans import master as M
    src = roles(spark, sf_dir)
    frames = scenario_frames(spark, src)
    members = M.memberships(frames, telemetry_bridge(src, ("webid",))) if with_members else None
    return src, frames, members, M


@register("master_account", Q.master_sql(S10_WINDOW))
def q_master_account(spark, sf_dir):
    src, frames, _, M = _master_parts(spark, sf_dir)
    return M.master_account(src, frames, OR)


@register("mart_counts", Q.mart_counts_sql(S10_WINDOW))
def q_mart_counts(spark, sf_dir):
    src, frames, _, M = _master_parts(spark, sf_dir)
    return M.mart_counts(frames, M.master_account(src, frames, OR))


@register("alerts_by_stage", Q.alerts_by_stage_sql(S10_WINDOW))
def q_alerts_by_stage(spark, sf_dir):
    from tidemark.operators.bridge import telemetry_bridge
    from tidemark.plans import master as M
    src = roles(spark, sf_dir)
    return M.alerts_by_stage(scenario_frames(spark, src), telemetry_bridge(src, ("webid",)))


@register("csm_worklist", Q.csm_worklist_sql(S10_WINDOW))
def q_csm_worklist(spark, sf_dir):
    src, _, members, M = _master_parts(spark, sf_dir, with_members=True)
    return M.csm_worklist(src, members, OR)


@register("latest_contract", Q.LATEST_CONTRACT)
def q_latest_contract(spark, sf_dir):
    from tidemark.plans.master import latest_contract
    return latest_contract(roles(spark, sf_dir))


@register("bridge_coverage", Q.BRIDGE_COVERAGE)
def q_bridge_coverage(spark, sf_dir):
    from tidemark.operators.bridge import bridge_coverage
    return bridge_coverage(roles(spark, sf_dir))


@register("bridge_orphans", Q.BRIDGE_ORPHANS)
def q_bridge_orphans(spark, sf_dir):
    from tidemark.operators.bridge import bridge_orphans
    return bridge_orphans(roles(spark, sf_dir))


def _enriched(sid: str) -> QueryFn:
    def q(spark, sf_dir):
        from tidemark.plans.master import enrich_telemetry
        src = roles(spark, sf_dir)
        return enrich_telemetry(_BUILDERS[sid](src), src)
    return q


for _n in Q.TELEMETRY_GRAIN:
    register(f"rpt_03_enriched_s{_n:02d}", Q.enriched_sql(f"S{_n}"))(_enriched(f"S{_n}"))


# ------------------------------------------------------ quirk-register options

register("scn_16_at_close", Q.s16_sql(at_close=True))(lambda spark, d: S.scn_16(roles(spark, d), as_of_close=True))

register("scn_12_all_signals", f"""
WITH l AS (SELECT account_id, COUNT(DISTINCT date) AS login_days_14d, MAX(date) AS last_login_date
  FROM login WHERE date >= {Q.O} - 14 GROUP BY account_id),
i AS (SELECT account_id, COUNT(*) AS n FROM il WHERE ev IS NOT NULL AND day >= {Q.O} - 14 GROUP BY account_id)
SELECT l.account_id AS telemetry_account_id, l.login_days_14d, COALESCE(i.n, 0) AS il_events_14d,
  CASE WHEN COALESCE(i.n, 0) = 0 THEN 'login-only risk' WHEN COALESCE(i.n, 0) < 3 THEN 'low IL engagement'
       ELSE 'healthy' END AS health_signal, l.last_login_date
FROM l LEFT JOIN i ON i.account_id = l.account_id WHERE l.login_days_14d > 0""")(
    lambda spark, d: S.scn_12(roles(spark, d), OR, only_alerts=False))

register("scn_13_spec_semantics", Q.S13_SPEC)(
    lambda spark, d: S.scn_13(roles(spark, d), EV, spec_semantics=True))

register("scn_03_active_license", f"""WITH s3 AS ({Q.SCENARIO_SQL['S3'].strip()}),
ak AS (SELECT DISTINCT 'platform:' || c.webid AS k FROM license_customer c
  WHERE c._fivetran_deleted = FALSE AND c.webid IS NOT NULL
    AND EXISTS (SELECT 1 FROM license_usage u WHERE u.customerid = c.customerid
                AND u.lastvalidateddate >= {Q.O} - 365))
SELECT * FROM s3 WHERE telemetry_account_id IN (SELECT k FROM ak)""")(
    lambda spark, d: S.scn_03(roles(spark, d), require_active_license_days=365, as_of=OR))

register("scn_10_180d", Q.s10_sql(180))(lambda spark, d: S.scn_10(roles(spark, d), window_days=180))


@register("alerts_by_owner", Q.alerts_by_owner_sql(S10_WINDOW))
def q_alerts_by_owner(spark, sf_dir):
    src, _, members, M = _master_parts(spark, sf_dir, with_members=True)
    return M.alerts_by_owner(src, members)
