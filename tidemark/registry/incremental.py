"""Registered queries of the incremental jobs: milestone state, identity,
change feed, mergeable sketches, business days, retention, paging, replay."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.operators import date_dim as DD, profile as P, retention as RT, sketches as SK
from tidemark.operators.changes import changes, write_run
from tidemark.operators.identity import account_identities
from tidemark.plans import refresh as R, scenarios as S
from tidemark.plans.master import scenario_order
from tidemark.publish import paging as PG, publish as PB
from tidemark.registry import oracle as Q
from tidemark.registry.jobs import BUSINESS_SQL, LINEAGE_SQL, business_dim
from tidemark.registry.queries import S10_WINDOW as Q_S10_WINDOW, register
from tidemark.session import checkpoint_dir
from tidemark.sources import staging as STG
from tidemark.sources.schemas import MART_SCHEMAS
from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, read_table, roles
from tidemark.streaming import state as ST

c = F.col


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------- milestone state per account

def _state(surface: str, log: str):
    """Four batches out of order, two of them more than once."""
    def query(spark, d):
        root, events = _folder(spark, "state"), getattr(roles(spark, d), log)
        part = F.pmod(F.xxhash64(*events.columns), F.lit(4))
        for k in (2, 0, 0, 3, 2, 1):
            ST.apply_batch(spark, root, surface, k, events.filter(part == k))
        return ST.read_profile(spark, root, surface)
    return query


def _ever(name: str) -> str:
    return f"CAST(MAX(CASE WHEN ev = '{name}' THEN 1 ELSE 0 END) AS INTEGER)"


def _days(func: str, name: str) -> str:
    return f"{func}(CASE WHEN ev = '{name}' THEN day END)"


register("milestone_state_rc", f"""SELECT account_id, {_ever(V.RC_HOME)} AS rc_home,
  {_ever(V.RC_UPLOAD_CLICKED)} AS clicked_upload, {_ever(V.RC_UPLOAD_PAGE)} AS reached_upload_page,
  {_ever(V.RC_LINEOS)} AS used_lineos, {_ever(V.RC_VIEW_ALL)} AS used_view_all,
  {_ever(V.RC_SCHEDULE_PAGE)} AS used_schedule, {_days('MIN', V.RC_SCHEDULE_PAGE)} AS first_schedule_page_visit,
  {_days('MAX', V.RC_SCHEDULE_PAGE)} AS last_schedule_page_visit,
  COUNT(CASE WHEN ev = '{V.RC_SCHEDULE_PAGE}' THEN 1 END) AS schedule_page_visits,
  {_ever(V.RC_SCHEDULE_CREATED)} AS completed_schedule, MIN(day) AS first_rc_event, MAX(day) AS last_rc_event,
  COUNT(DISTINCT ev) AS distinct_rc_events
FROM rc GROUP BY account_id""")(_state("RC", "rc_events"))


def _sessions(name: str) -> str:
    return f"COUNT(DISTINCT CASE WHEN ev = '{name}' THEN session_id END)"


register("milestone_state_il", f"""SELECT account_id,
  CAST(MAX(CASE WHEN ev IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS il_named, {_ever(V.IL_HOME)} AS visited_il_home,
  {_ever(V.IL_BUTTON)} AS clicked_il_button, {_ever(V.IL_CREATE_RULE)} AS started_rule,
  {_ever(V.IL_SUBSCRIBERS)} AS added_subscriber, {_ever(V.IL_SAVE_RULE)} AS saved_rule,
  {_ever(V.IL_RESULTS)} AS viewed_results_only, COUNT(DISTINCT session_id) AS total_il_sessions,
  {_days('MIN', V.IL_SAVE_RULE)} AS first_rule_saved_date, {_days('MAX', V.IL_SAVE_RULE)} AS last_rule_saved_date,
  COUNT(CASE WHEN ev = '{V.IL_SAVE_RULE}' THEN 1 END) AS rule_save_events,
  {_days('MAX', V.IL_RESULTS)} AS last_results_view, {_days('MAX', V.IL_EDIT_RULE)} AS last_rule_edit,
  {_sessions(V.IL_SAVE_RULE)} AS save_sessions, {_sessions(V.IL_DELETE_RULE)} AS delete_sessions,
  MAX(day) AS last_il_event, MAX(CASE WHEN ev IS NOT NULL THEN day END) AS last_named_il_event
FROM il GROUP BY account_id""")(_state("IL", "il_events"))


# -------------------------------------------------------------------- identity

register("account_identities", """WITH RECURSIVE live AS (
  SELECT id, 'platform:' || platform_legacy_id_c AS tkey FROM account WHERE _fivetran_deleted = FALSE),
b AS (SELECT live.id AS a, cust.tkey AS k, 'webid' AS path FROM live JOIN cust ON cust.salesforceid = live.id
      WHERE cust.tkey IS NOT NULL
      UNION SELECT id, tkey, 'legacy' FROM live WHERE tkey IS NOT NULL),
near AS (SELECT DISTINCT x.a AS a, y.a AS other FROM b x JOIN b y ON x.k = y.k),
reach AS (SELECT a, other FROM near UNION SELECT reach.a, near.other FROM reach JOIN near ON near.a = reach.other),
placed AS (SELECT a, MIN(other) AS cluster_id, COUNT(DISTINCT other) AS n FROM reach GROUP BY a),
ids AS (SELECT placed.cluster_id, COUNT(DISTINCT b.k) AS k FROM b JOIN placed ON placed.a = b.a GROUP BY 1),
own AS (SELECT a, bool_or(path = 'webid') AS w, bool_or(path = 'legacy') AS l FROM b GROUP BY a),
agree AS (SELECT DISTINCT x.a FROM b x JOIN b y ON x.a = y.a AND x.k = y.k AND x.path = 'webid' AND y.path = 'legacy')
SELECT live.id AS sfdc_account_id, COALESCE(placed.cluster_id, live.id) AS cluster_id,
  COALESCE(placed.n, 1) AS cluster_accounts, COALESCE(ids.k, 0) AS cluster_telemetry_ids,
  CASE WHEN own.w AND own.l THEN 'both' WHEN own.w THEN 'webid' WHEN own.l THEN 'legacy' ELSE 'none' END AS path,
  COALESCE(placed.n, 1) > 1 AS conflict,
  COALESCE(own.w AND own.l AND agree.a IS NULL, FALSE) AS paths_disagree
FROM live LEFT JOIN placed ON placed.a = live.id LEFT JOIN ids ON ids.cluster_id = placed.cluster_id
  LEFT JOIN own ON own.a = live.id LEFT JOIN agree ON agree.a = live.id""")(
    lambda spark, d: account_identities(roles(spark, d)))


# ----------------------------------------------------------------- change feed

_LATER = dt.date(2001, 8, 9)


def _change_feed(spark, d):
    """S14 of the reference day against the week after."""
    src, out = roles(spark, d), _folder(spark, "runs")
    write_run(S.scn_14(src, ORDERS_AS_OF), f"{out}/a", ["sfdc_account_id"])
    write_run(S.scn_14(src, _LATER), f"{out}/b", ["sfdc_account_id"])
    return (changes(spark, f"{out}/a", f"{out}/b", ["sfdc_account_id"])
            .withColumn("changed_columns", F.array_join("changed_columns", ",")))


_S14_VALUES = [f.name for f in MART_SCHEMAS["S14"].fields if f.name != "sfdc_account_id"]
register("change_feed", f"""WITH p AS (SELECT *, TRUE AS here FROM ({Q.SCENARIO_SQL['S14'].strip()})),
n AS (SELECT *, TRUE AS here FROM ({Q.s14_sql(f"DATE '{_LATER}'")})),
m AS (SELECT COALESCE(p.sfdc_account_id, n.sfdc_account_id) AS sfdc_account_id,
    CASE WHEN p.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN p.here AND n.here THEN concat_ws(',', {', '.join(
        f"CASE WHEN p.{x} IS DISTINCT FROM n.{x} THEN '{x}' END" for x in _S14_VALUES)}) ELSE '' END AS changed_columns
  FROM p FULL OUTER JOIN n ON n.sfdc_account_id = p.sfdc_account_id)
SELECT * FROM m WHERE change <> 'changed' OR changed_columns <> ''""")(_change_feed)


# ----------------------------------------------------- sketches kept per day

_QS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _quantiles(spark, d):
    """Quantiles of the order prices of each year, from daily sketches, and
    whether their exact ranks are within the bound."""
    orders, path = read_table(spark, d, "orders"), f"{_folder(spark, 'quantiles')}/orders"
    SK.store_quantiles(orders, path, "o_orderdate", ["o_totalprice"])
    est = SK.quantiles(spark, path, _QS, period="year(day)")
    met = est.join(orders.select(F.year("o_orderdate").alias("period"), c("o_totalprice").alias("x")), "period")
    ranks = met.groupBy("period", "quantile", "rows").agg(
        F.count_if(c("x") < c("value")).alias("below"), F.count_if(c("x") <= c("value")).alias("upto"))
    slack = SK.RANK_ERROR * c("rows") + 1
    return ranks.select(c("period").alias("year"), "quantile", "rows",
                        ((c("below") <= c("quantile") * c("rows") + slack)
                         & (c("upto") >= c("quantile") * c("rows") - slack)).alias("within_bound"))


register("daily_quantiles", f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, q AS quantile, COUNT(*) AS "rows",
  TRUE AS within_bound
FROM orders, (SELECT unnest([{", ".join(f"{q}::DOUBLE" for q in _QS)}]) AS q) GROUP BY 1, 2""")(_quantiles)


def _profile_store(spark, d):
    """The events' column profile from daily sketches against exact counts."""
    events, path = read_table(spark, d, "events"), f"{_folder(spark, 'profile')}/events"
    SK.store_profile(events, path, "ts")
    exact = P.column_profile(events, "events", exact=True).select("column_name", c("distinct_count").alias("_exact"))
    got = SK.stored_profile(spark, path, "events").join(exact, "column_name")
    near = F.abs(c("distinct_count") - c("_exact")) <= 4 * SK.DISTINCT_ERROR * c("_exact") + 1
    return got.select("table_name", "column_name", "row_count", "null_count", near.alias("within_bound"))


register("profile_store", "\nUNION ALL\n".join(
    f"SELECT 'events' AS table_name, '{n}' AS column_name, COUNT(*) AS row_count, "
    f"COUNT(*) FILTER (WHERE {n} IS NULL) AS null_count, TRUE AS within_bound FROM events"
    for n in ("event_id", "ts", "user_id", "event_type", "value", "props")))(_profile_store)


# --------------------------------------------------------------- business days

def _business_arithmetic(spark, d):
    """Per order day: the day five business days later, the one three before,
    and the business days left until the month's end."""
    dim = DD.with_business_index(business_dim(spark, d))
    days = (read_table(spark, d, "orders").groupBy(c("o_orderdate").cast("date").alias("order_day"))
            .agg(F.count(F.lit(1)).alias("orders")).withColumn("month_end", F.last_day("order_day")))
    out = DD.business_days_after(days, "order_day", 5, dim)
    out = DD.business_days_after(out, "order_day", -3, dim, "remind_day")
    return DD.business_days_between(out, "order_day", "month_end", dim, "days_to_month_end")


register("business_day_arithmetic", f"""WITH {BUSINESS_SQL},
work AS (SELECT date_day, ROW_NUMBER() OVER (ORDER BY date_day) AS k FROM b WHERE is_business_day),
upto AS (SELECT b.date_day, COUNT(work.k) AS k FROM b LEFT JOIN work ON work.date_day <= b.date_day GROUP BY 1),
o AS (SELECT CAST(o_orderdate AS DATE) AS order_day, COUNT(*) AS orders, last_day(CAST(MIN(o_orderdate) AS DATE)) AS month_end
  FROM orders GROUP BY 1)
SELECT o.order_day, o.orders, o.month_end, due.date_day AS due_day, remind.date_day AS remind_day,
  CAST(e.k - s.k AS BIGINT) AS days_to_month_end
FROM o LEFT JOIN upto s ON s.date_day = o.order_day LEFT JOIN upto e ON e.date_day = o.month_end
  LEFT JOIN work due ON due.k = s.k + 5 LEFT JOIN work remind ON remind.k = s.k - 3""")(_business_arithmetic)


# ---------------------------------------------------------- retention by day

register("retention_by_day", """WITH u AS (
  SELECT DISTINCT customerid, assigneduser, CAST(lastvalidateddate AS DATE) AS day FROM license_usage
  WHERE assigneduser IS NOT NULL AND lastvalidateddate IS NOT NULL),
pts AS (SELECT DISTINCT customerid, day + after AS day FROM u, (SELECT unnest([0, 30, 31, 61]) AS after)),
n AS (SELECT pts.customerid, pts.day,
    COUNT(DISTINCT CASE WHEN u.day >= pts.day - 30 THEN u.assigneduser END) AS curr,
    COUNT(DISTINCT CASE WHEN u.day <= pts.day - 30 THEN u.assigneduser END) AS prev
  FROM pts LEFT JOIN u ON u.customerid = pts.customerid AND u.day BETWEEN pts.day - 60 AND pts.day
  GROUP BY 1, 2),
moved AS (SELECT * FROM n WINDOW w AS (PARTITION BY customerid ORDER BY day)
  QUALIFY curr <> COALESCE(LAG(curr) OVER w, 0) OR prev <> COALESCE(LAG(prev) OVER w, 0)),
spans AS (SELECT customerid, day AS from_day,
    LEAD(day) OVER (PARTITION BY customerid ORDER BY day) - 1 AS to_day, curr, prev FROM moved)
SELECT customerid, CAST(from_day AS DATE) AS from_day, CAST(to_day AS DATE) AS to_day, curr, prev,
  ROUND(curr * 100.0 / CAST(NULLIF(prev, 0) AS DOUBLE), 1) AS retention_pct
FROM spans WHERE curr > 0 OR prev > 0""")(
    lambda spark, d: RT.retention_spans(roles(spark, d).license_usage, "customerid", "assigneduser",
                                        "lastvalidateddate", 30))


# -------------------------------------------------------------------- paging

_PAGE, _ORDER = 400, [("days_to_renewal", "asc"), ("arr", "desc"), ("sfdc_account_id", "asc")]


def _pages(spark, d):
    """S14 published sorted and read by key, every page from the first on."""
    path = f"{_folder(spark, 'pages')}/s14"
    mart = S.scn_14(roles(spark, d), ORDERS_AS_OF)
    PG.write_sorted(mart, path, _ORDER, rows_per_file=150)
    return PG.pages_after(spark, path, _ORDER, _PAGE).select("page", "place", "sfdc_account_id", "days_to_renewal")


register("keyset_pages", f"""WITH s14 AS ({Q.SCENARIO_SQL['S14'].strip()}),
n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY days_to_renewal ASC NULLS LAST, arr DESC NULLS FIRST,
  sfdc_account_id ASC NULLS LAST) - 1 AS k FROM s14)
SELECT CAST(k // {_PAGE} AS INTEGER) AS page, CAST(k % {_PAGE} AS INTEGER) AS place, sfdc_account_id, days_to_renewal
FROM n""")(_pages)


# --------------------------------------------------------- quarantine replay

def _replayed(spark, d):
    """RC events staged by a parser that knows ISO days only; what it rejected
    is staged again by the present one. Rows by status before and after."""
    rc, root = roles(spark, d).rc_events, _folder(spark, "staged")
    count = F.count(F.lit(1)).alias("rows")
    before = STG.stage_batch(rc, root, "0", {"event_time": "iso_date"}).groupBy("status").agg(count).collect()
    after = STG.replay(spark, root, rc.schema, "1", {"event_time": "date"}).groupBy("status").agg(count)
    known = spark.createDataFrame([("before", *r) for r in before], "phase string, status string, rows long")
    return known.unionByName(after.select(F.lit("after").alias("phase"), "status", "rows"))


_BLANK = "event_time IS NULL OR trim(event_time) = ''"
_ISO = "regexp_matches(event_time, '^\\s*\\d{4}-\\d{1,2}-\\d{1,2}(\\s*$|[ T])')"
register("quarantine_replay", f"""WITH n AS (
  SELECT 'before' AS phase, CASE WHEN {_BLANK} OR {_ISO} THEN 'kept' ELSE 'rejected' END AS status FROM rc_events
  UNION ALL SELECT 'after', CASE WHEN {_BLANK} OR {Q.td('event_time')} IS NOT NULL THEN 'kept' ELSE 'rejected' END
  FROM rc_events)
SELECT phase, status, COUNT(*) AS "rows" FROM n GROUP BY 1, 2""")(_replayed)


# ------------------------------------------------- refresh, export, dry run

def _refreshed(spark, d):
    """A whole refresh, announced, and each mart read back through the log of
    versions: in numeric order, with the rows it was announced with, the rows
    it has, and whether it keeps its contract."""
    root, src = _folder(spark, "refresh"), roles(spark, d)
    with contextlib.redirect_stdout(io.StringIO()):
        report = R.run_all(spark, src, ORDERS_AS_OF, root, events_as_of=EVENTS_AS_OF, run_id="r1")
    tables, parts = dict(V.MART_TABLES, MASTER=V.MASTER_TABLE), []
    for sid, table in tables.items():
        df = PB.read_mart(spark, root, table, order_by=[])
        parts.append(df.agg(F.count(F.lit(1)).alias("published_rows")).select(
            F.lit(sid).alias("scenario"), "published_rows", F.lit(not R.contract_violations(sid, df)).alias("keeps_contract")))
    read = reduce(DataFrame.unionByName, parts)
    return report.join(read, "scenario").withColumn("position", scenario_order())


register("refresh_published", f"""SELECT scenario, "rows", "rows" AS published_rows, TRUE AS keeps_contract,
  CAST(CASE scenario WHEN 'MASTER' THEN 16 ELSE CAST(scenario[2:] AS INTEGER) - 1 END AS INTEGER) AS position
FROM ({Q.mart_counts_sql(Q_S10_WINDOW)})""")(_refreshed)


def _exported(spark, d):
    """S6 written as a dated CSV and read again."""
    mart = S.scn_06(roles(spark, d), EVENTS_AS_OF)
    path = PB.export_csv(mart, _folder(spark, "export"), "S6_schedule_dropoff", EVENTS_AS_OF,
                         S.order_columns(S.DEFAULT_ORDER["S6"]))
    return spark.read.schema(mart.schema).option("header", True).csv(path)


register("csv_export", Q.SCENARIO_SQL["S6"])(_exported)


def _dry_runs(spark, d):
    """The tables in each scenario's physical plan, which is not run, with
    their rows."""
    src, found = roles(spark, d), []
    for sid, build in R.default_builders(ORDERS_AS_OF, EVENTS_AS_OF).items():
        found += [(sid, t) for t in sorted(set(re.findall(r"/(\w+)\.parquet", PB.dry_run(build(src)))))]
    tables = sorted({t for _, t in found})
    counts = reduce(DataFrame.unionByName, [
        read_table(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("source"), "rows") for t in tables])
    return spark.createDataFrame(found, "mart string, source string").join(counts, "source")


register("dry_run_tables", LINEAGE_SQL + " WHERE reads.mart <> 'MASTER'")(_dry_runs)

register("staging_soft_deletes", """SELECT customerid, assigneduser, dateassigned, registered, _fivetran_deleted
FROM license_key WHERE _fivetran_deleted = FALSE""")(
    lambda spark, d: STG.stage(roles(spark, d).license_key, names={"CustomerID": "customerid"})
    .select("customerid", "assigneduser", "dateassigned", "registered", "_fivetran_deleted"))
