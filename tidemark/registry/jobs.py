"""Registered supporting jobs: date dimension, staging, profiling, quality,
concepts and the event rollup — each with its DuckDB oracle SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.dates import older_than
from tidemark.operators import date_dim as DD
from tidemark.operators.kernels import event_date
from tidemark.operators import profile as P
from tidemark.operators import quality as QL
from tidemark.plans import concepts as CP
from tidemark.plans import scenarios as S
from tidemark.registry import oracle as Q
from tidemark.registry.queries import register
from tidemark.sources import staging as STG
from tidemark.plans.master import master_account
from tidemark.plans.refresh import default_builders
from tidemark.publish import lineage as LN
from tidemark.publish.publish import lineage
from tidemark.session import checkpoint_dir
from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, ROLE_TABLES, arr_daily, read_table, roles
from tidemark.streaming.rollup import event_daily_rollup, restage_days

c = F.col
O, E = Q.O, Q.E


# ------------------------------------------------------------- date dimension

def _dim_sql(offset: int = 0) -> str:
    fd = f"CAST(d - INTERVAL {offset} MONTH AS DATE)" if offset else "d"
    qe = "CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
    ye = "make_date(year(d), 12, 31)"
    return f"""WITH b AS (SELECT CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi
  FROM orders),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM b)
SELECT d AS date_day, CAST(year(d) AS INTEGER) AS calendar_year,
  CAST(quarter(d) AS INTEGER) AS calendar_quarter, CAST(month(d) AS INTEGER) AS calendar_month,
  CAST(day(d) AS INTEGER) AS calendar_day_of_month, CAST(dayofweek(d) AS INTEGER) AS day_of_week,
  CAST(dayofyear(d) AS INTEGER) AS day_of_year,
  CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end,
  CAST(date_trunc('quarter', d) AS DATE) AS quarter_start, {qe} AS quarter_end,
  CAST(date_trunc('year', d) AS DATE) AS year_start, {ye} AS year_end,
  CAST(d - INTERVAL 1 YEAR AS DATE) AS prior_year_same_day,
  last_day(CAST(d - INTERVAL 1 YEAR AS DATE)) AS prior_year_month_end,
  CAST(year({fd}) AS INTEGER) AS fiscal_year, CAST(quarter({fd}) AS INTEGER) AS fiscal_quarter,
  CAST(month({fd}) AS INTEGER) AS fiscal_month,
  dayofweek(d) IN (0, 6) AS is_weekend, d = last_day(d) AS is_month_end,
  d = {qe} AS is_quarter_end, d = {ye} AS is_year_end
FROM days"""


def _orders_dim(spark, sf_dir, offset=0):
    return DD.date_dim_for(read_table(spark, sf_dir, "orders"), "o_orderdate", offset)


register("date_dim", _dim_sql())(lambda spark, d: _orders_dim(spark, d))
register("date_dim_fiscal", _dim_sql(3))(lambda spark, d: _orders_dim(spark, d, 3))

# Holidays of the test data: one day of the year per nation, in every year.
HOLIDAY_SQL = "SELECT n_nationkey * 14 + 1 FROM nation"


def business_dim(spark, sf_dir):
    """The dimension over the orders with the nations' holidays."""
    dim = _orders_dim(spark, sf_dir)
    days = read_table(spark, sf_dir, "nation").select((c("n_nationkey") * 14 + 1).alias("_n")).distinct()
    return DD.with_business_days(dim, dim.join(days, c("day_of_year") == c("_n"), "left_semi").select("date_day"))


BUSINESS_SQL = f"""dim AS ({_dim_sql()}),
b AS (SELECT *, day_of_year IN ({HOLIDAY_SQL}) AS is_holiday,
  NOT is_weekend AND day_of_year NOT IN ({HOLIDAY_SQL}) AS is_business_day FROM dim)"""
register("business_days", f"""WITH {BUSINESS_SQL}
SELECT *, CAST(SUM(CAST(is_business_day AS INTEGER)) OVER (PARTITION BY month_start ORDER BY date_day
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS business_day_of_month FROM b""")(business_dim)

register("prior_year_compare", f"""WITH dim AS ({_dim_sql()}),
monthly AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month_end, COUNT(*) AS value
  FROM orders GROUP BY 1)
SELECT m.month_end, m.prior_year_month_end, cur.value, prv.value AS prior_year_value,
  ROUND(CAST(cur.value - prv.value AS DOUBLE) * 100.0 / NULLIF(prv.value, 0), 1) AS yoy_pct
FROM (SELECT month_end, prior_year_month_end FROM dim WHERE is_month_end) m
LEFT JOIN monthly cur ON cur.month_end = m.month_end
LEFT JOIN monthly prv ON prv.month_end = m.prior_year_month_end""")(
    lambda spark, d: DD.prior_year_compare(read_table(spark, d, "orders"), "o_orderdate",
                                           F.count(F.lit(1)), _orders_dim(spark, d)))


register("prior_year_days", f"""WITH dim AS ({_dim_sql()}),
daily AS (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT dim.date_day, dim.prior_year_same_day, cur.n AS value, prv.n AS prior_year_value
FROM dim LEFT JOIN daily cur ON cur.d = dim.date_day LEFT JOIN daily prv ON prv.d = dim.prior_year_same_day""")(
    lambda spark, d: DD.prior_year_days(read_table(spark, d, "orders"), "o_orderdate", F.count(F.lit(1)),
                                        _orders_dim(spark, d)))


# -------------------------------------------------------------------- staging

_QUAR = "event_time IS NOT NULL AND trim(event_time) <> '' AND " + Q.td("event_time") + " IS NULL"


def _quarantine(spark, d):
    src = roles(spark, d)
    types = {"event_time": "date"}
    return (STG.quarantine_counts(src.rc_events, types, "rc_events")
            .unionByName(STG.quarantine_counts(src.il_events, types, "il_events")))


register("staging_quarantine", f"""
SELECT 'rc_events' AS table_name, 'event_time' AS column_name, COUNT(*) FILTER (WHERE {_QUAR}) AS bad_values
FROM rc_events
UNION ALL
SELECT 'il_events', 'event_time', COUNT(*) FILTER (WHERE {_QUAR}) FROM il_events""")(_quarantine)


register("staging_quarantine_rows", f"""
SELECT 'rc_events' AS table_name, account_id, event_time, 'event_time' AS failed_column FROM rc_events WHERE {_QUAR}
UNION ALL SELECT 'il_events', account_id, event_time, 'event_time' FROM il_events WHERE {_QUAR}""")(
    lambda spark, d: (lambda src: STG.quarantine_rows(src.rc_events, {"event_time": "date"}).select(
        F.lit("rc_events").alias("table_name"), "account_id", "event_time", "failed_column").unionByName(
        STG.quarantine_rows(src.il_events, {"event_time": "date"}).select(
            F.lit("il_events").alias("table_name"), "account_id", "event_time", "failed_column")))(roles(spark, d)))


def _restaged(spark, d):
    """A day-partitioned RC log gets its late half: the rows of every third
    account, undated ones among them."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-restaged-{uuid.uuid4().hex}"
    rc = roles(spark, d).rc_events
    late = F.pmod(F.crc32("account_id"), F.lit(3)) == 0
    day = STG.day_of("event_time", rc).alias("event_day")
    STG.by_day(rc.filter(~late).select("*", day), "event_day").write.partitionBy("event_day").parquet(out)
    restage_days(rc, out, "event_time", "event_day", rc.filter(late).select(day))
    return spark.read.parquet(out).groupBy("event_day").agg(F.count(F.lit(1)).alias("rows"))


register("restaged_days", 'SELECT day AS event_day, COUNT(*) AS "rows" FROM rc GROUP BY 1')(_restaged)

def _lineage_of_plans(spark, d):
    """Lineage of every mart and the master view, read from their plans."""
    src = roles(spark, d).tagged()
    frames = {sid: build(src) for sid, build in default_builders(ORDERS_AS_OF, EVENTS_AS_OF).items()}
    found = {sid: LN.read(df) for sid, df in frames.items()}
    master = master_account(src, {sid: LN.tagged(sid, df) for sid, df in frames.items()}, ORDERS_AS_OF)
    return found | {"MASTER": LN.read(master)}


def _lineage_rows(spark, d):
    """The source tables that each mart's plan reads, and how many rows they have now."""
    own = {m: sorted(x.sources & set(ROLE_TABLES)) for m, x in _lineage_of_plans(spark, d).items()}
    lin = lineage(spark, own, roles(spark, d).locations).filter(c("kind") == "input_table")
    counts = reduce(lambda a, b: a.unionByName(b), [
        read_table(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("source"), "rows")
        for t in ("customer", "events", "lineitem", "nation", "orders")])
    return lin.select("mart", F.regexp_extract("name", r"([^/]+)\.parquet$", 1).alias("source")).join(counts, "source")


LINEAGE_SQL = """WITH reads(mart, source) AS (VALUES
  ('S1', 'customer'), ('S1', 'orders'), ('S2', 'customer'), ('S2', 'lineitem'), ('S2', 'orders'),
  ('S3', 'events'), ('S3', 'orders'), ('S4', 'customer'), ('S4', 'events'), ('S4', 'lineitem'), ('S4', 'orders'),
  ('S5', 'customer'), ('S5', 'events'), ('S5', 'lineitem'), ('S5', 'orders'), ('S6', 'events'), ('S7', 'events'),
  ('S8', 'events'), ('S9', 'events'), ('S10', 'customer'), ('S10', 'lineitem'), ('S10', 'orders'),
  ('S11', 'customer'), ('S11', 'lineitem'), ('S11', 'orders'), ('S12', 'events'), ('S12', 'orders'), ('S13', 'events'),
  ('S14', 'customer'), ('S14', 'events'), ('S14', 'lineitem'), ('S14', 'orders'), ('S15', 'customer'),
  ('S15', 'lineitem'), ('S15', 'orders'), ('S16', 'customer'), ('S16', 'events'), ('S16', 'lineitem'),
  ('S16', 'orders'), ('MASTER', 'customer'), ('MASTER', 'nation'), ('MASTER', 'orders')),
n AS (SELECT 'customer' AS source, COUNT(*) AS "rows" FROM customer UNION ALL SELECT 'events', COUNT(*) FROM events
  UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem UNION ALL SELECT 'nation', COUNT(*) FROM nation
  UNION ALL SELECT 'orders', COUNT(*) FROM orders)
SELECT reads.mart, reads.source, n."rows" FROM reads JOIN n ON n.source = reads.source"""
register("lineage_source_rows", LINEAGE_SQL)(_lineage_rows)


def _lineage_columns(spark, d):
    """Column lineage of three marts, each source column with its known values."""
    found = {m: x for m, x in _lineage_of_plans(spark, d).items() if m in ("S6", "S10", "S12")}
    pairs = LN.column_rows(spark, found)
    src, parts = roles(spark, d), []
    for role in sorted({s for x in found.values() for s in x.sources}):
        df = getattr(src, role)
        wide = df.agg(*[F.count(f"`{n}`").alias(n) for n in df.columns])
        stack = ", ".join(f"'{n}', `{n}`" for n in df.columns)
        parts.append(wide.selectExpr(f"'{role}' AS source", f"stack({len(df.columns)}, {stack}) AS (source_column, known_values)"))
    return pairs.join(reduce(lambda a, b: a.unionByName(b), parts), ["source", "source_column"])


_KNOWN = {"rc_events": ["account_id", "event_time", "tracked_event_name"],
          "il_events": ["account_id", "event_time", "tracked_event_name"], "login": ["account_id", "date"],
          "license_usage": ["assigneduser", "customerid", "lastvalidateddate"],
          "license_customer": ["_fivetran_deleted", "customerid", "salesforceid", "customername"],
          "account": ["id", "type", "active_product_lines_c", "next_renewal_date_c", "open_renewable_amount_c",
                      "customer_success_associate_c"]}
register("lineage_columns", """WITH made(mart, column_name, source, source_column) AS (VALUES
  ('S6', '*', 'rc_events', 'account_id'), ('S6', '*', 'rc_events', 'event_time'),
  ('S6', '*', 'rc_events', 'tracked_event_name'), ('S6', 'telemetry_account_id', 'rc_events', 'account_id'),
  ('S6', 'first_schedule_page_visit', 'rc_events', 'event_time'),
  ('S6', 'first_schedule_page_visit', 'rc_events', 'tracked_event_name'),
  ('S6', 'last_schedule_page_visit', 'rc_events', 'event_time'),
  ('S6', 'last_schedule_page_visit', 'rc_events', 'tracked_event_name'),
  ('S6', 'schedule_page_visits', 'rc_events', 'tracked_event_name'),
  ('S6', 'completed_schedule', 'rc_events', 'tracked_event_name'),
  ('S6', 'days_since_first_visit', 'rc_events', 'event_time'),
  ('S6', 'days_since_first_visit', 'rc_events', 'tracked_event_name'),
  ('S10', '*', 'account', 'id'), ('S10', '*', 'license_customer', '_fivetran_deleted'),
  ('S10', '*', 'license_customer', 'customerid'), ('S10', '*', 'license_customer', 'salesforceid'),
  ('S10', '*', 'license_usage', 'assigneduser'), ('S10', '*', 'license_usage', 'customerid'),
  ('S10', '*', 'license_usage', 'lastvalidateddate'),
  ('S10', 'licensing_customer_id', 'license_usage', 'customerid'),
  ('S10', 'account_name', 'license_customer', 'customername'),
  ('S10', 'sfdc_account_id', 'license_customer', 'salesforceid'), ('S10', 'account_type', 'account', 'type'),
  ('S10', 'product_lines', 'account', 'active_product_lines_c'),
  ('S10', 'active_users_prev_30d', 'license_usage', 'assigneduser'),
  ('S10', 'active_users_prev_30d', 'license_usage', 'lastvalidateddate'),
  ('S10', 'active_users_curr_30d', 'license_usage', 'assigneduser'),
  ('S10', 'active_users_curr_30d', 'license_usage', 'lastvalidateddate'),
  ('S10', 'utilization_retention_pct', 'license_usage', 'assigneduser'),
  ('S10', 'utilization_retention_pct', 'license_usage', 'lastvalidateddate'),
  ('S10', 'next_renewal_date', 'account', 'next_renewal_date_c'),
  ('S10', 'arr_at_risk', 'account', 'open_renewable_amount_c'),
  ('S10', 'csm_id', 'account', 'customer_success_associate_c'),
  ('S12', '*', 'il_events', 'account_id'), ('S12', '*', 'il_events', 'event_time'),
  ('S12', '*', 'il_events', 'tracked_event_name'), ('S12', '*', 'login', 'account_id'), ('S12', '*', 'login', 'date'),
  ('S12', 'telemetry_account_id', 'login', 'account_id'), ('S12', 'login_days_14d', 'login', 'date'),
  ('S12', 'last_login_date', 'login', 'date')),
n AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS source, '{x}' AS source_column, COUNT({x}) AS known_values FROM {t}" for t, xs in _KNOWN.items()
    for x in xs) + """)
SELECT made.mart, made.column_name, made.source, made.source_column, n.known_values
FROM made JOIN n ON n.source = made.source AND n.source_column = made.source_column""")(_lineage_columns)


def _bool_sql(col: str) -> str:
    t = f"lower(trim(CAST({col} AS VARCHAR)))"
    return (f"CASE WHEN {t} IN ('1','true','t','y','yes') THEN TRUE "
            f"WHEN {t} IN ('0','false','f','n','no') THEN FALSE END")


register("staging_labels", f"""SELECT doc_id, {_bool_sql('quality')} AS is_quality,
  {_bool_sql('toxic')} AS is_toxic FROM labels""")(
    lambda spark, d: read_table(spark, d, "labels").select(
        "doc_id", STG.to_bool("quality").alias("is_quality"), STG.to_bool("toxic").alias("is_toxic")))

register("staging_login_dedupe", "SELECT DISTINCT account_id, date FROM login")(
    lambda spark, d: STG.dedupe(roles(spark, d).login, ["account_id", "date"]))


def _junk(spark, d):
    rc = roles(spark, d).rc_events
    _, dropped = STG.drop_junk(rc, {
        "null_account": c("account_id").isNull(),
        "unparseable_time": event_date().isNull()})
    return dropped.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("rows"))


register("staging_junk", """
SELECT CASE WHEN account_id IS NULL THEN 'null_account' ELSE 'unparseable_time' END AS drop_reason,
  COUNT(*) AS "rows"
FROM rc WHERE account_id IS NULL OR day IS NULL
GROUP BY 1""")(_junk)


def _staged_events(spark, d):
    ev = read_table(spark, d, "events")
    return STG.stage(ev, names={"user_id": "account_key", "ts": "event_ts"},
                     types={"event_type": "string", "props": "string"}, keys=["event_id"])


register("staging_events", """
SELECT DISTINCT ON (event_id) event_id, ts AS event_ts, user_id AS account_key,
  NULLIF(trim(event_type), '') AS event_type, value, NULLIF(trim(props), '') AS props
FROM events""")(_staged_events)


# ------------------------------------------------------------------ profiling

_INV_DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
_INV_COLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
             "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
             "benchmark": 2, "labels": 3, "conversations": 4}


def _inventory(spark, d):
    return P.table_inventory({t: read_table(spark, d, t) for t in _INV_COLS}, _INV_DATES)


register("profile_inventory", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, CAST({n} AS INTEGER) AS column_count, "
    + (f"CAST(MAX({_INV_DATES[t]}) AS TIMESTAMP)" if t in _INV_DATES else "CAST(NULL AS TIMESTAMP)")
    + f" AS last_update FROM {t}" for t, n in _INV_COLS.items()))(_inventory)


def _ranges(spark, d):
    parts = [P.date_ranges(read_table(spark, d, t), t) for t in ("orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


register("profile_date_ranges", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{col}' AS column_name, CAST(MIN({col}) AS TIMESTAMP) AS min_value, "
    f"CAST(MAX({col}) AS TIMESTAMP) AS max_value FROM {t}" for t, col in _INV_DATES.items()))(_ranges)

_CUST_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
               ("c_acctbal", "double"), ("c_mktsegment", "string")]
register("profile_customer", "\nUNION ALL\n".join(
    f"SELECT 'customer' AS table_name, COUNT(*) AS row_count, '{n}' AS column_name, "
    f"'{t}' AS data_type, COUNT(*) FILTER (WHERE {n} IS NULL) AS null_count, "
    f"COUNT(DISTINCT {n}) AS distinct_count FROM customer" for n, t in _CUST_TYPES))(
    lambda spark, d: P.column_profile(read_table(spark, d, "customer"), "customer", exact=True))


def _key_sql(name: str, table: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    nul = " OR ".join(f"{x} IS NULL" for x in keys)
    return f"""WITH g AS (SELECT {k}, COUNT(*) AS n, MAX(CASE WHEN {nul} THEN 1 ELSE 0 END) AS nul
  FROM {table} GROUP BY {k})
SELECT '{name}' AS name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS "rows",
  CAST(COALESCE(SUM(CASE WHEN nul = 1 THEN n ELSE 0 END), 0) AS BIGINT) AS null_key_rows,
  COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys,
  CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT) AS duplicate_rows,
  COUNT(*) FILTER (WHERE n > 1) = 0 AND COALESCE(SUM(CASE WHEN nul = 1 THEN n ELSE 0 END), 0) = 0
    AS is_unique
FROM g"""


register("key_check", _key_sql("orders.o_orderkey", "orders", ["o_orderkey"]))(
    lambda spark, d: P.key_check(read_table(spark, d, "orders"), ["o_orderkey"], "orders.o_orderkey"))

register("key_check_login", _key_sql("login(account_id, date)", "login", ["account_id", "date"]))(
    lambda spark, d: P.key_check(roles(spark, d).login, ["account_id", "date"], "login(account_id, date)"))

register("grain_check", f"WITH s14 AS ({Q.SCENARIO_SQL['S14'].strip()}),\n"
         + _key_sql("S14 per account", "s14", ["sfdc_account_id"])[len("WITH "):])(
    lambda spark, d: P.key_check(S.scn_14(roles(spark, d), ORDERS_AS_OF), ["sfdc_account_id"],
                                 "S14 per account"))

register("fk_check", """WITH ck AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL),
pk AS (SELECT DISTINCT c_custkey AS p FROM customer WHERE c_custkey IS NOT NULL),
j AS (SELECT COUNT(*) AS child_keys, COUNT(pk.p) AS matched_keys FROM ck LEFT JOIN pk ON ck.k = pk.p)
SELECT 'orders.o_custkey -> customer' AS name, child_keys, matched_keys,
  child_keys - matched_keys AS orphan_keys,
  ROUND(CAST(matched_keys AS DOUBLE) * 100.0 / NULLIF(child_keys, 0), 1) AS inclusion_pct FROM j""")(
    lambda spark, d: P.fk_check(read_table(spark, d, "orders"), "o_custkey",
                                read_table(spark, d, "customer"), "c_custkey",
                                "orders.o_custkey -> customer"))

register("fk_check_bridge", """WITH ck AS (SELECT DISTINCT account_id AS k FROM rc_events WHERE account_id IS NOT NULL),
pk AS (SELECT DISTINCT 'platform:' || webid AS p FROM license_customer WHERE webid IS NOT NULL),
j AS (SELECT COUNT(*) AS child_keys, COUNT(pk.p) AS matched_keys FROM ck LEFT JOIN pk ON ck.k = pk.p)
SELECT 'rc_events.account_id -> webid' AS name, child_keys, matched_keys,
  child_keys - matched_keys AS orphan_keys,
  ROUND(CAST(matched_keys AS DOUBLE) * 100.0 / NULLIF(child_keys, 0), 1) AS inclusion_pct FROM j""")(
    lambda spark, d: (lambda src: P.fk_check(
        src.rc_events, "account_id",
        src.license_customer.select(F.concat(F.lit(V.TELEMETRY_PREFIX), c("webid")).alias("k")), "k",
        "rc_events.account_id -> webid"))(roles(spark, d)))

register("profile_sample", """SELECT customerid, sha256('s1' || assigneduser) AS assigneduser,
  sha256('s1' || customeremail) AS customeremail, dateassigned, lastvalidateddate, registered, deactivated,
  _fivetran_deleted
FROM license_key WHERE CAST('0x' || substr(md5(concat_ws('|', 's1', CAST(customerid AS VARCHAR), assigneduser)), 1, 8)
  AS BIGINT) < CAST(floor(0.01 * 4294967296) AS BIGINT)""")(
    lambda spark, d: P.sample_rows(roles(spark, d).license_key, 0.01, ["customerid", "assigneduser"], salt="s1",
                                   mask=["customeremail", "assigneduser"]))


# -------------------------------------------------------------------- quality

def _freshness(spark, d):
    src = roles(spark, d)
    return QL.freshness({
        "login": (src.login, "date"),
        "rc_events": (src.rc_events.select(event_date().alias("d")), "d"),
        "il_events": (src.il_events.select(event_date().alias("d")), "d"),
        "license_usage": (src.license_usage, "lastvalidateddate")}, EVENTS_AS_OF, 2)


def _fresh_sql(name, expr, table):
    return (f"SELECT '{name}' AS feed, CAST(MAX({expr}) AS DATE) AS latest_date, "
            f"CAST(date_diff('day', CAST(MAX({expr}) AS DATE), {E}) AS INTEGER) AS lag_days, "
            f"COALESCE(date_diff('day', CAST(MAX({expr}) AS DATE), {E}) > 2, TRUE) AS stale FROM {table}")


register("freshness", "\nUNION ALL\n".join([
    _fresh_sql("login", "date", "login"),
    _fresh_sql("rc_events", "day", "rc"),
    _fresh_sql("il_events", "day", "il"),
    _fresh_sql("license_usage", "lastvalidateddate", "license_usage")]))(_freshness)


def _rules(spark, d):
    o = read_table(spark, d, "orders")
    y98 = F.year("o_orderdate") == 1998
    return QL.validation_rules(o, [
        ("orders_1998", QL.rule_agg("count", "o_orderkey", y98), 1.0, None),
        ("avg_price_1998", F.round(QL.rule_agg("avg", "o_totalprice", y98), 2), 100000.0, 200000.0),
        ("max_price", QL.rule_agg("max", "o_totalprice"), None, 1000000.0),
        ("customers_1998", QL.rule_agg("count_distinct", "o_custkey", y98), 100.0, None)], "orders")


register("validation_rules", """WITH v AS (
  SELECT CAST(COUNT(o_orderkey) FILTER (WHERE year(o_orderdate) = 1998) AS DOUBLE) AS orders_1998,
    CAST(ROUND(AVG(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998), 2) AS DOUBLE) AS avg_price_1998,
    CAST(MAX(o_totalprice) AS DOUBLE) AS max_price,
    CAST(COUNT(DISTINCT o_custkey) FILTER (WHERE year(o_orderdate) = 1998) AS DOUBLE) AS customers_1998
  FROM orders),
r AS (
  SELECT 'orders_1998' AS rule, orders_1998 AS value, 1.0::DOUBLE AS lo, NULL::DOUBLE AS hi FROM v
  UNION ALL SELECT 'avg_price_1998', avg_price_1998, 100000.0, 200000.0 FROM v
  UNION ALL SELECT 'max_price', max_price, NULL, 1000000.0 FROM v
  UNION ALL SELECT 'customers_1998', customers_1998, 100.0, NULL FROM v)
SELECT 'orders' AS table_name, rule, value, lo, hi,
  value IS NOT NULL AND (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) AS passed
FROM r""")(_rules)


def _assert_s14(spark, d):
    m = S.scn_14(roles(spark, d), ORDERS_AS_OF)
    return QL.assertions(m, "S14", 1, ["sfdc_account_id", "renewal_date"],
                         {"renewal_in_window": c("days_to_renewal").between(0, 120),
                          "tier_known": c("risk_tier").isin(V.TIER_RED, V.TIER_AMBER, V.TIER_GREEN)})


register("mart_assertions", f"""WITH s14 AS ({Q.SCENARIO_SQL['S14'].strip()}),
a AS (SELECT COUNT(*) AS n,
  COUNT(*) FILTER (WHERE sfdc_account_id IS NULL) AS nn_id,
  COUNT(*) FILTER (WHERE renewal_date IS NULL) AS nn_rd,
  COUNT(*) FILTER (WHERE NOT COALESCE(days_to_renewal BETWEEN 0 AND 120, FALSE)) AS inv_w,
  COUNT(*) FILTER (WHERE NOT COALESCE(risk_tier IN ('RED', 'AMBER', 'GREEN'), FALSE)) AS inv_t
  FROM s14),
r AS (
  SELECT 'min_rows:1' AS rule, CAST(GREATEST(1 - n, 0) AS BIGINT) AS violations FROM a
  UNION ALL SELECT 'not_null:sfdc_account_id', nn_id FROM a
  UNION ALL SELECT 'not_null:renewal_date', nn_rd FROM a
  UNION ALL SELECT 'invariant:renewal_in_window', inv_w FROM a
  UNION ALL SELECT 'invariant:tier_known', inv_t FROM a)
SELECT 'S14' AS table_name, rule, violations, violations = 0 AS passed FROM r""")(_assert_s14)

_NEXT_WEEK = dt.date(2001, 8, 9)


def _snapshot(spark, d):
    src = roles(spark, d)
    return QL.snapshot_diff(S.scn_14(src, ORDERS_AS_OF), S.scn_14(src, _NEXT_WEEK))


register("snapshot_diff", f"""WITH prev AS ({Q.SCENARIO_SQL['S14'].strip()}),
curr AS ({Q.s14_sql("DATE '2001-08-09'")})
SELECT 'previous_rows' AS measure, COUNT(*) AS "rows" FROM prev
UNION ALL SELECT 'current_rows', COUNT(*) FROM curr
UNION ALL SELECT 'added_rows', COUNT(*) FROM (SELECT * FROM curr EXCEPT ALL SELECT * FROM prev) x
UNION ALL SELECT 'removed_rows', COUNT(*) FROM (SELECT * FROM prev EXCEPT ALL SELECT * FROM curr) y""")(
    _snapshot)

_S2_STEPS = [("registered", "registered = TRUE"),
             ("never validated", "lastvalidateddate IS NULL"),
             ("not deactivated", "deactivated IS NULL"),
             ("assigned > 2 days ago", f"dateassigned < {O} - 2"),
             ("not deleted", "_fivetran_deleted = FALSE")]


def _diagnosis(spark, d):
    k = roles(spark, d).license_key
    return QL.zero_row_diagnosis(k, [
        ("registered", c("registered") == F.lit(True)),
        ("never validated", c("lastvalidateddate").isNull()),
        ("not deactivated", c("deactivated").isNull()),
        ("assigned > 2 days ago", older_than("dateassigned", ORDERS_AS_OF, 2)),
        ("not deleted", c("_fivetran_deleted") == F.lit(False))])


def _diag_sql() -> str:
    parts = ["SELECT 0 AS step, 'all rows' AS predicate, COUNT(*) AS surviving_rows FROM license_key"]
    acc = []
    for i, (name, pred) in enumerate(_S2_STEPS, 1):
        acc.append(f"({pred})")
        parts.append(f"SELECT {i}, '{name}', COUNT(*) FILTER (WHERE COALESCE({' AND '.join(acc)}, FALSE)) "
                     f"FROM license_key")
    return "\nUNION ALL ".join(parts)


register("zero_row_diagnosis", _diag_sql())(_diagnosis)

register("isolation_counts", """SELECT COUNT(*) AS "rows", COUNT(DISTINCT o_custkey) AS distinct_keys,
  MIN(o_totalprice) AS min_value, MAX(o_totalprice) AS max_value, ROUND(AVG(o_totalprice), 4) AS avg_value
FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'""")(
    lambda spark, d: QL.isolation_counts(read_table(spark, d, "orders"), "o_custkey", "o_orderdate",
                                         "1998-01-01", "1998-12-31", "o_totalprice"))


# ------------------------------------------------------------------- concepts

_ARR = """arr_daily AS (
  SELECT '001' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS account_id,
    CAST(o_orderdate AS DATE) AS snapshot_date, o_orderkey AS snapshot_id,
    CAST(o_totalprice AS DECIMAL(18, 2)) AS arr,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Test' ELSE 'Customer' END AS customer_type
  FROM orders),
mes AS (
  SELECT account_id, month_end, snapshot_date, arr FROM (
    SELECT *, last_day(snapshot_date) AS month_end,
      ROW_NUMBER() OVER (PARTITION BY account_id, last_day(snapshot_date)
                         ORDER BY snapshot_date DESC, snapshot_id DESC) AS rn
    FROM arr_daily WHERE customer_type NOT IN ('Test', 'Internal') OR customer_type IS NULL) t
  WHERE rn = 1)"""

_BY_MONTH = f"""{_ARR},
dim AS ({_dim_sql()}),
bym AS (
  SELECT account_id, month_end, arr AS ending_arr,
    CASE WHEN LAG(month_end) OVER w = last_day(CAST(month_end - INTERVAL 1 MONTH AS DATE))
         THEN LAG(arr) OVER w ELSE CAST(0 AS DECIMAL(18, 2)) END AS starting_arr
  FROM mes WINDOW w AS (PARTITION BY account_id ORDER BY month_end))"""


def _by_month(spark, d):
    return CP.arr_by_account_month(arr_daily(spark, d), _orders_dim(spark, d))


def _as_double(df, *columns):
    """Exact sums leave a query as doubles, as the other figures."""
    return df.withColumns({x: c(x).cast("double") for x in columns})


register("month_end_snapshot", f"""WITH {_ARR}
SELECT account_id, month_end, snapshot_date, CAST(arr AS DOUBLE) AS arr FROM mes""")(
    lambda spark, d: _as_double(CP.month_end_snapshot(arr_daily(spark, d)), "arr"))

register("arr_by_account_month", f"""WITH {_BY_MONTH}
SELECT b.account_id, b.month_end, d.fiscal_year, d.fiscal_quarter, d.fiscal_month,
  CAST(b.starting_arr AS DOUBLE) AS starting_arr, CAST(b.ending_arr AS DOUBLE) AS ending_arr
FROM bym b LEFT JOIN dim d ON d.date_day = b.month_end AND d.is_month_end""")(
    lambda spark, d: _as_double(_by_month(spark, d), "starting_arr", "ending_arr"))

register("gross_retention", f"""WITH {_BY_MONTH}
SELECT month_end, COUNT(*) AS cohort_accounts, CAST(SUM(starting_arr) AS DOUBLE) AS arr_cohort,
  CAST(SUM(LEAST(ending_arr, starting_arr)) AS DOUBLE) AS retained_arr,
  ROUND(CAST(SUM(LEAST(ending_arr, starting_arr)) AS DOUBLE) * 100.0 / CAST(SUM(starting_arr) AS DOUBLE), 1)
    AS gross_retention_pct
FROM bym WHERE starting_arr > 0 GROUP BY month_end""")(
    lambda spark, d: _as_double(CP.gross_retention(_by_month(spark, d)), "arr_cohort", "retained_arr"))

register("active_at_month_end", """WITH span AS (
  SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS f, CAST(MAX(o_orderdate) AS DATE) AS l
  FROM orders GROUP BY o_custkey),
m AS (SELECT o_custkey, l, last_day(CAST(unnest(generate_series(date_trunc('month', f),
        date_trunc('month', l), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM span)
SELECT month_end, COUNT(DISTINCT o_custkey) AS active_accounts FROM m WHERE month_end <= l
GROUP BY month_end""")(
    lambda spark, d: CP.active_at_month_end(read_table(spark, d, "orders"), "o_custkey", "o_orderdate"))


# --------------------------------------------------------------- event rollup

register("event_daily_rollup", """WITH ev AS (
  SELECT 'RC' AS surface, account_id, tracked_event_name, event_time, CAST(NULL AS VARCHAR) AS session_id FROM rc_events
  UNION ALL SELECT 'IL', account_id, tracked_event_name, event_time, session_id FROM il_events)
SELECT surface, account_id, session_id, """ + Q.td("event_time") + """ AS event_date, tracked_event_name,
  COUNT(*) AS events, MIN(TRY_CAST(CASE WHEN regexp_matches(event_time, '^\\d{4}-\\d{2}-\\d{2}') THEN event_time END AS TIMESTAMP)) AS first_event_time,
  MAX(TRY_CAST(CASE WHEN regexp_matches(event_time, '^\\d{4}-\\d{2}-\\d{2}') THEN event_time END AS TIMESTAMP)) AS last_event_time
FROM ev GROUP BY 1, 2, 3, 4, 5""")(
    lambda spark, d: (lambda src: event_daily_rollup(src.rc_events, src.il_events))(roles(spark, d)))


# JN-11: period lookup through the date dimension.
register("jn_11_date_dim_lookup", f"""WITH dim AS ({_dim_sql(3)})
SELECT d.fiscal_year, d.fiscal_quarter, COUNT(*) AS orders, COUNT(DISTINCT o.o_custkey) AS customers
FROM orders o LEFT JOIN dim d ON d.date_day = CAST(o.o_orderdate AS DATE)
GROUP BY d.fiscal_year, d.fiscal_quarter""")(
    lambda spark, d: DD.join_dim(read_table(spark, d, "orders"), _orders_dim(spark, d, 3), "o_orderdate")
    .groupBy("fiscal_year", "fiscal_quarter")
    .agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers")))
