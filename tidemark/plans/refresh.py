"""Refresh of all marts in dependency order (OPS-01) with lineage (OPS-02).

Scenario marts are written first; the master view and the count report then
read the *written* marts (mart-on-mart, as in the source), which cuts the
lineage: a lost executor during the master build recomputes from the stored
marts, not from the raw event log. All output goes to the shared folder the
caller names (on a cluster: the shared store, never a local disk).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.operators.bridge import telemetry_bridge
from tidemark.operators.quality import assertions, contract_check
from tidemark.plans import master as M
from tidemark.plans import scenarios as S
from tidemark.plans.telemetry import Telemetry, customer_use, profile_name, telemetry_profiles
from tidemark.publish.lineage import ROWS, Lineage, column_rows, differences, read as read_lineage, tagged
from tidemark.publish.publish import announce, lineage, observed_write, write_mart
from tidemark.publish.versions import NONE, latest
from tidemark.sources.registry import Sources
from tidemark.sources.schemas import MART_SCHEMAS
from tidemark.sources.staging import materialize_sources
from tidemark.streaming.rollup import read_rollup
from tidemark.streaming.state import state_profiles

# Declared dependencies (what each mart reads). A refresh compares them with
# what the plans read (``publish.lineage``).
DEPENDS_ON = {
    "S1": ["account", "contract", "onboarding"], "S2": ["license_key", "license_customer", "account"],
    "S3": ["login", "rc_events"], "S4": ["license_usage", "license_customer", "rc_events", "account"],
    "S5": ["license_usage", "license_customer", "rc_events", "account"], "S6": ["rc_events"],
    "S7": ["rc_events", "il_events"], "S8": ["il_events"], "S9": ["il_events"],
    "S10": ["license_usage", "license_customer", "account"],
    "S11": ["license_customer", "license_key", "account"], "S12": ["login", "il_events"],
    "S13": ["il_events"],
    "S14": ["account", "login", "il_events", "license_customer", "license_usage", "license_key"],
    "S15": ["license_customer", "license_usage", "account"],
    "S16": ["opportunity", "account", "il_events", "rc_events", "license_customer", "license_usage"],
    "MASTER": ["account", "user", "contract", "license_customer"] + [f"S{i}" for i in range(1, 17)],
}


def default_builders(as_of, events_as_of=None, usage_ref=None, tel: Telemetry | None = None
                     ) -> dict[str, Callable[[Sources], DataFrame]]:
    """Scenario builders with one ``as_of`` (telemetry scenarios may use their
    own, e.g. the last complete event day). ``usage_ref`` is S10's reference
    day (default: the latest usage day, a subquery of the plan). With ``tel``
    every scenario reads the shared profiles instead of the logs."""
    ev = events_as_of or as_of
    return {
        "S1": lambda s: S.scn_01(s, as_of), "S2": lambda s: S.scn_02(s, as_of, tel=tel),
        "S3": lambda s: S.scn_03(s, tel=tel), "S4": lambda s: S.scn_04(s, as_of, tel=tel),
        "S5": lambda s: S.scn_05(s, tel=tel), "S6": lambda s: S.scn_06(s, ev, tel=tel),
        "S7": lambda s: S.scn_07(s, ev, tel=tel), "S8": lambda s: S.scn_08(s, tel=tel),
        "S9": lambda s: S.scn_09(s, ev, tel=tel),
        "S10": lambda s: S.scn_10(s, usage_ref, tel=tel),
        "S11": lambda s: S.scn_11(s, as_of, tel=tel), "S12": lambda s: S.scn_12(s, as_of, tel=tel),
        "S13": lambda s: S.scn_13(s, ev, tel=tel), "S14": lambda s: S.scn_14(s, as_of, tel=tel),
        "S15": lambda s: S.scn_15(s, as_of, tel=tel), "S16": lambda s: S.scn_16(s, tel=tel),
    }


# The log behind each profile.
PROFILED = {"rc": "rc_events", "il": "il_events", "usage": "license_usage", "login": "login",
            "use": "license_usage", "keys": "license_key"}


def write_profiles(spark: SparkSession, src: Sources, out_dir: str, rollup: str | None = None,
                   state: str | None = None, found: dict[str, Lineage] | None = None) -> Telemetry:
    """Reduce every log once, write the profiles and read them back (lineage
    is cut there). With ``rollup`` (the folder of the incremental event
    rollup) or ``state`` (that of the accounts' milestone state) the event logs
    are not read. ``found`` takes the profiles' lineage."""
    prof = telemetry_profiles(src, read_rollup(spark, rollup) if rollup else None)
    if state:
        prof = replace(prof, **state_profiles(spark, state))
    def write(name: str) -> None:
        df, log = getattr(prof, name), PROFILED[name]
        # Usage per customer comes from the usage per day as written, not from the log.
        write_mart(customer_use(spark.read.parquet(f"{out_dir}/usage")) if name == "use" else df, f"{out_dir}/{name}")
        if found is not None:
            own = read_lineage(df)
            if not own.sources:  # a rollup or state stands for its log
                own = Lineage({log}, {x: {(log, ROWS)} for x in [ROWS, *df.columns]})
            found[profile_name(name)] = own
        if name == "usage":
            write("use")

    with ThreadPoolExecutor(max_workers=len(PROFILED)) as pool:
        list(pool.map(write, [n for n in PROFILED if n != "use"]))
    return Telemetry(**{n: spark.read.parquet(f"{out_dir}/{n}") for n in PROFILED})


def write_marts(spark: SparkSession, src: Sources, builders: dict[str, Callable[[Sources], DataFrame]], out_dir: str,
                parallel: int = 4, found: dict[str, Lineage] | None = None
                ) -> tuple[dict[str, DataFrame], dict[str, int], list[str]]:
    """Write every scenario mart and read it back: frames, row counts, log
    lines. The marts are independent of each other, so they are submitted as
    concurrent Spark jobs and small stages of one overlap with others.
    ``found`` takes the marts' lineage."""
    def build(sid: str) -> tuple[int, str]:
        df = builders[sid](src)
        if found is not None:
            found[sid] = read_lineage(df)
        return observed_write(df, f"{out_dir}/{V.MART_TABLES[sid]}", sid)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        done = dict(zip(V.SCENARIO_IDS, pool.map(build, V.SCENARIO_IDS)))
    frames = {sid: spark.read.parquet(f"{out_dir}/{V.MART_TABLES[sid]}") for sid in V.SCENARIO_IDS}
    return frames, {sid: n for sid, (n, _) in done.items()}, [line for _, line in done.values()]


def contract_violations(mart: str, df: DataFrame) -> list[str]:
    """Columns and types of a mart against its contract."""
    if mart not in MART_SCHEMAS:
        return []
    return [f"{mart}.{n}: {status}" for n, _, _, status in contract_check(df, MART_SCHEMAS[mart]) if status != "ok"]


# What every refresh must show: least rows, columns without NULL, invariants
# (SQL) that hold in each row. Marts may be empty, the master view may not.
ASSERTIONS: dict[str, tuple[int, tuple[str, ...], dict[str, str]]] = {
    "S1": (0, ("sfdc_account_id", "contract_signed_date"), {"age": "days_since_signature > 1"}),
    "S2": (0, ("key_assigned_date",), {"age": "days_since_assigned > 2"}),
    "S3": (0, ("telemetry_account_id",), {"logins": "total_login_days > 0"}),
    "S4": (0, ("licensing_customer_id",), {"span": "first_product_use <= last_product_use", "stalled": "reached_upload_page = 0"}),
    "S5": (0, ("licensing_customer_id",), {"days": "active_days > 0 AND active_span_days >= 0"}),
    "S6": (0, ("telemetry_account_id",), {"visits": "schedule_page_visits > 0 AND completed_schedule = 0"}),
    "S7": (0, ("telemetry_account_id",), {"none": "total_il_events = 0"}),
    "S8": (0, ("telemetry_account_id",), {"unsaved": "saved_rule = 0"}),
    "S9": (0, ("telemetry_account_id",), {"saved": "first_rule_saved_date <= last_rule_saved_date"}),
    "S10": (0, ("licensing_customer_id",), {"dropped": "2 * active_users_curr_30d < active_users_prev_30d"}),
    "S11": (0, (), {"seats": "dormant_seats BETWEEN 0 AND total_registered_seats", "share": "dormancy_pct BETWEEN 0 AND 100"}),
    "S12": (0, ("telemetry_account_id",), {"logins": "login_days_14d > 0"}),
    "S13": (0, ("telemetry_account_id",), {"counts": "total_rules_saved >= 0 AND rules_deleted >= 0"}),
    "S14": (0, ("sfdc_account_id", "renewal_date"), {"window": "days_to_renewal BETWEEN 0 AND 120",
                                                     "tier": "risk_tier IN ('RED', 'AMBER', 'GREEN')"}),
    "S15": (0, ("licensing_customer_id",), {"active": "users_still_active >= 0", "lapsed": "NOT on_maintenance"}),
    "S16": (0, ("opportunity_id",), {"flags": "ever_saved_rule IN (0, 1) AND ever_uploaded_report IN (0, 1)"}),
    "MASTER": (1, ("sfdc_account_id",), {"scenarios": "active_scenario_count BETWEEN 0 AND 16"}),
}


def assertion_violations(mart: str, df: DataFrame) -> list[str]:
    """Rows, NULL keys and invariants of a mart (one pass over it)."""
    if mart not in ASSERTIONS:
        return []
    least, keys, invariants = ASSERTIONS[mart]
    rows = assertions(df, mart, least, list(keys), {n: F.expr(p) for n, p in invariants.items()})
    return [f"{mart}: {r.rule} violated {r.violations} times" for r in rows.collect() if not r.passed]


def mart_violations(mart: str, df: DataFrame) -> list[str]:
    """The default gate: the mart's contract, then its assertions."""
    return contract_violations(mart, df) or assertion_violations(mart, df)


def run_all(spark: SparkSession, src: Sources, as_of, out_dir: str,
            builders: dict[str, Callable[[Sources], DataFrame]] | None = None, *,
            events_as_of=None, usage_ref=None, share_telemetry: bool = True,
            parallel_marts: int = 4, stage_sources: bool = False, partition_by_day: bool = True,
            rollup: str | None = None, state: str | None = None, run_id: str | None = None,
            gate: Callable[[str, DataFrame], list[str]] = mart_violations) -> DataFrame:
    """Build every mart, then the master view and the count report.

    With ``stage_sources`` every role is first written once to
    ``<out_dir>/_staging`` (roles that are views over raw data are computed
    once; usage and logins partitioned by day, so lookback windows prune). With
    ``share_telemetry`` each log is reduced once to a profile, written to
    ``<out_dir>/_profiles`` and read back, and every scenario reads the
    profiles; ``rollup`` names an incremental event rollup to build the event
    profiles from, ``state`` a milestone state (``streaming.state``) that has
    them.

    ``gate(mart, written frame)`` returns what is wrong with a mart (default:
    its contract and its ``ASSERTIONS``). With ``run_id`` everything is written under
    ``<out_dir>/run_id=<id>`` and announced as the next version of
    ``<out_dir>`` only after every mart, the master view and the report
    succeeded and no gate objected — all marts in one version — so readers
    (``publish.read_mart``) switch from one complete refresh to the next and
    never see a mix of old and new marts. An objection raises, and the previous
    refresh stays; so does it when another refresh was announced meanwhile
    (``versions.ConcurrentRefresh``).

    What each mart reads is taken from its plan and written to ``_lineage``
    (tables and dependencies) and ``_lineage_columns`` (column by column); a
    difference to ``DEPENDS_ON`` raises.

    Returns the (scenario, rows) report; the counts come from write-time
    observations, so no mart is scanned a second time just to count it.
    """
    root, based_on = out_dir, None
    if run_id is not None:
        based_on = (latest(spark, root) or {"version": NONE})["version"]
        out_dir = f"{root}/run_id={run_id}"
    locations = src.locations
    if stage_sources:
        src = materialize_sources(spark, src, f"{out_dir}/_staging", parallel_marts,
                                  partition_by_day=partition_by_day)
    profiles: dict[str, Lineage] = {}
    found: dict[str, Lineage] = {}
    src, declared = src.tagged(), builders is None
    if builders is None:
        tel = None
        if share_telemetry:
            tel = write_profiles(spark, src, f"{out_dir}/_profiles", rollup, state, profiles).tagged()
        builders = default_builders(as_of, events_as_of, usage_ref, tel)
    marts, counts, lines = write_marts(spark, src, builders, out_dir, parallel_marts, found)
    named = {sid: tagged(sid, df) for sid, df in marts.items()}
    master = M.master_account(src, named, as_of)
    found["MASTER"] = read_lineage(master)
    found = {mart: own.through(profiles) for mart, own in found.items()}
    alerts = M.alerts_by_stage(marts, telemetry_bridge(src, ("webid",)))
    with ThreadPoolExecutor(max_workers=2) as pool:
        f_master = pool.submit(observed_write, master, f"{out_dir}/{V.MASTER_TABLE}", "MASTER")
        f_alerts = pool.submit(observed_write, alerts, f"{out_dir}/ALERTS_BY_STAGE", "ALERTS")
        counts["MASTER"], line = f_master.result()
        f_alerts.result()
    print("\n".join([*lines, line]))
    marts["MASTER"] = spark.read.parquet(f"{out_dir}/{V.MASTER_TABLE}")
    lineage(spark, {m: sorted(own.sources) for m, own in found.items()}, locations).write.mode("overwrite").parquet(
        f"{out_dir}/_lineage")
    column_rows(spark, found).write.mode("overwrite").parquet(f"{out_dir}/_lineage_columns")
    if declared and (wrong := differences(found, DEPENDS_ON)):
        raise ValueError(f"refresh {run_id or out_dir} not announced: {'; '.join(wrong)}")
    with ThreadPoolExecutor(max_workers=max(1, parallel_marts)) as pool:
        wrong = [x for found_wrong in pool.map(lambda m: gate(*m), marts.items()) for x in found_wrong]
    if wrong:
        raise ValueError(f"refresh {run_id or out_dir} not announced: {'; '.join(wrong)}")
    if run_id is not None:
        tables = dict(V.MART_TABLES, MASTER=V.MASTER_TABLE)
        announce(spark, root, run_id, {tables[k]: (f"{out_dir}/{tables[k]}", n) for k, n in counts.items()},
                 based_on)
    return spark.createDataFrame(sorted(counts.items()), "scenario string, rows long")
