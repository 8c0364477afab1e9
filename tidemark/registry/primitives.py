"""One small registered query per relational primitive of SURVEY §2.1–2.8,
named from its ID, over whole test tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import (day_diff, due_within, feed_as_of, older_than, on_or_after, parse_date,
                                      quarter_end, year_end)
from tidemark.functions.predicates import flag_sum, null_or_empty, ratio, telemetry_key, tier
from tidemark.operators.kernels import (distinct, distinct_entities, ever, first, keys_that, last,
                                        milestones, count_if, window_retention)
from tidemark.plans import scenarios as S
from tidemark.publish.publish import default_order, page
from tidemark.registry import oracle as Q
from tidemark.registry.queries import register
from tidemark.sources.testmap import ORDERS_AS_OF, read_table, roles

c = F.col
O = Q.O


def _t(spark, d, name):
    return read_table(spark, d, name)


# ---------------------------------------------------------------- projections

register("prj_03_case_label", """SELECT c_custkey,
  CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN 'low'
       WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS balance_band FROM customer""")(
    lambda spark, d: _t(spark, d, "customer").select(
        "c_custkey", tier([(c("c_acctbal") < 0, "negative"), (c("c_acctbal") < 1000, "low"),
                           (c("c_acctbal") < 5000, "mid")], "high").alias("balance_band")))

register("prj_05_flag_sum", """SELECT c_custkey,
  (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)
  + (CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END) AS flags_set FROM customer""")(
    lambda spark, d: _t(spark, d, "customer").select(
        "c_custkey", flag_sum([c("c_acctbal") < 0, c("c_mktsegment") == "BUILDING",
                               c("c_nationkey") < 10]).alias("flags_set")))

# -------------------------------------------------------------------- filters

register("flt_04_null_or_empty", """SELECT id, customer_success_associate_c FROM account
WHERE customer_success_associate_c IS NULL OR customer_success_associate_c = ''""")(
    lambda spark, d: roles(spark, d).account.filter(null_or_empty("customer_success_associate_c"))
    .select("id", "customer_success_associate_c"))

register("flt_05_ilike", """SELECT id, active_product_lines_c FROM account
WHERE active_product_lines_c ILIKE '%angles professional%'""")(
    lambda spark, d: roles(spark, d).account.filter(c("active_product_lines_c").ilike("%angles professional%"))
    .select("id", "active_product_lines_c"))

register("flt_06_age_predicate", f"""SELECT o_orderkey, o_orderdate FROM orders
WHERE date_diff('day', CAST(o_orderdate AS DATE), {O}) > 365""")(
    lambda spark, d: _t(spark, d, "orders").filter(older_than("o_orderdate", ORDERS_AS_OF, 365))
    .select("o_orderkey", "o_orderdate"))

register("flt_07_between", f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_day
FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN {O} AND {O} + 120""")(
    lambda spark, d: _t(spark, d, "lineitem").withColumn("ship_day", c("l_shipdate").cast("date"))
    .filter(due_within("ship_day", ORDERS_AS_OF, 120)).select("l_orderkey", "l_linenumber", "ship_day"))

register("flt_08_lookback", f"""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= {O} - 90""")(
    lambda spark, d: _t(spark, d, "orders").filter(on_or_after("o_orderdate", ORDERS_AS_OF, 90))
    .select("o_orderkey", "o_custkey"))

register("flt_11_disjunction", """SELECT c_custkey FROM customer
WHERE (c_acctbal < 0 AND c_mktsegment = 'BUILDING') OR (c_nationkey = 1 AND c_acctbal > 9000)""")(
    lambda spark, d: _t(spark, d, "customer").filter(
        ((c("c_acctbal") < 0) & (c("c_mktsegment") == "BUILDING"))
        | ((c("c_nationkey") == 1) & (c("c_acctbal") > 9000))).select("c_custkey"))

register("flt_12_safe_ratio", """SELECT n_nationkey,
  CAST(COUNT(c_custkey) FILTER (WHERE c_acctbal < 0) AS DOUBLE)
    / NULLIF(COUNT(c_custkey) FILTER (WHERE c_acctbal > 9000), 0) AS negative_per_rich
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")(
    lambda spark, d: _t(spark, d, "nation").join(_t(spark, d, "customer"), c("c_nationkey") == c("n_nationkey"),
                                                 "left")
    .groupBy("n_nationkey").agg(F.count(F.when(c("c_acctbal") < 0, c("c_custkey"))).alias("neg"),
                                F.count(F.when(c("c_acctbal") > 9000, c("c_custkey"))).alias("rich"))
    .select("n_nationkey", ratio("neg", "rich").alias("negative_per_rich")))

# ---------------------------------------------------------------------- joins

register("jn_03_computed_key", """SELECT c.customerid, COUNT(r.account_id) AS rc_events
FROM license_customer c LEFT JOIN rc_events r ON r.account_id = 'platform:' || c.webid
GROUP BY c.customerid""")(
    lambda spark, d: (lambda src: src.license_customer.join(
        src.rc_events.groupBy(c("account_id").alias("_k")).agg(F.count(F.lit(1)).alias("_n")),
        telemetry_key("webid") == c("_k"), "left")
        .select("customerid", F.coalesce("_n", F.lit(0)).alias("rc_events")))(roles(spark, d)))

register("jn_04_on_clause_filter", f"""SELECT c_custkey, COUNT(o_orderkey) AS orders_last_year
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= {O} - 365
GROUP BY c_custkey""")(
    lambda spark, d: _t(spark, d, "customer").join(
        _t(spark, d, "orders").filter(on_or_after("o_orderdate", ORDERS_AS_OF, 365))
        .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n")), c("o_custkey") == c("c_custkey"), "left")
    .select("c_custkey", F.coalesce("_n", F.lit(0)).alias("orders_last_year")))

register("jn_07_anti", """SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= DATE '2001-01-01')""")(
    lambda spark, d: _t(spark, d, "customer").join(
        keys_that(_t(spark, d, "orders").filter(c("o_orderdate") >= F.lit("2001-01-01").cast("date")),
                  "o_custkey", name_col=None), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"))

register("jn_08_semi", """SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")(
    lambda spark, d: _t(spark, d, "customer").join(
        _t(spark, d, "orders").filter(c("o_orderpriority") == "1-URGENT"), c("c_custkey") == c("o_custkey"),
        "left_semi").select("c_custkey", "c_name"))

# --------------------------------------------------------------- aggregations

_EV = "CAST(ts AS DATE)"


def _events(spark, d):
    return _t(spark, d, "events")


register("agg_04_05_06_milestones", f"""SELECT user_id,
  MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ever_purchased,
  MIN(CASE WHEN event_type = 'purchase' THEN {_EV} END) AS first_purchase,
  MAX(CASE WHEN event_type = 'error' THEN {_EV} END) AS last_error,
  COUNT(CASE WHEN event_type = 'signup' THEN 1 END) AS signups
FROM events GROUP BY user_id""")(
    lambda spark, d: milestones(_events(spark, d), "user_id", {
        "ever_purchased": ever(c("event_type") == "purchase"),
        "first_purchase": first(c("event_type") == "purchase", c("ts").cast("date")),
        "last_error": last(c("event_type") == "error", c("ts").cast("date")),
        "signups": count_if(c("event_type") == "signup")}))

register("agg_09_11_distinct_two_level", """SELECT user_id,
  COUNT(DISTINCT json_extract_string(props, '$.k')) AS sessions,
  COUNT(DISTINCT CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k') END)
    AS purchase_sessions,
  COUNT(DISTINCT CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END) AS error_sessions
FROM events GROUP BY user_id""")(
    lambda spark, d: milestones(_events(spark, d).withColumn("k", F.get_json_object("props", "$.k")),
                                "user_id", {"sessions": distinct(),
                                            "purchase_sessions": distinct(c("event_type") == "purchase"),
                                            "error_sessions": distinct(c("event_type") == "error")},
                                distinct_col="k"))

register("agg_10_distinct_expression", """SELECT customerid,
  COUNT(DISTINCT CAST(lastvalidateddate AS DATE)) AS active_days FROM license_usage GROUP BY customerid""")(
    lambda spark, d: roles(spark, d).license_usage.groupBy("customerid")
    .agg(F.count_distinct(c("lastvalidateddate").cast("date")).alias("active_days")))

register("agg_11_conditional_distinct", """SELECT customerid,
  COUNT(DISTINCT CASE WHEN year(lastvalidateddate) = 1998 THEN assigneduser END) AS users_1998,
  COUNT(DISTINCT CASE WHEN year(lastvalidateddate) = 1999 THEN assigneduser END) AS users_1999
FROM license_usage GROUP BY customerid""")(
    lambda spark, d: distinct_entities(roles(spark, d).license_usage, "customerid", "assigneduser", {
        "users_1998": F.year("lastvalidateddate") == 1998,
        "users_1999": F.year("lastvalidateddate") == 1999}).select(
        "customerid", "users_1998", "users_1999"))

register("agg_14_two_windows", """WITH ref AS (SELECT CAST(MAX(ts) AS DATE) AS r FROM events)
SELECT user_id,
  COUNT(DISTINCT CASE WHEN ts >= r - 7 THEN event_type END) AS curr,
  COUNT(DISTINCT CASE WHEN ts BETWEEN r - 14 AND r - 7 THEN event_type END) AS prev
FROM events CROSS JOIN ref WHERE ts >= r - 14 GROUP BY user_id""")(
    lambda spark, d: (lambda ev: window_retention(
        ev, "user_id", "event_type", "ts", feed_as_of(ev, "ts"), 7))(
        _events(spark, d)))

# ----------------------------------------------------------- windows and sort

register("srt_04_top_k", """SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total_value
FROM orders GROUP BY o_custkey ORDER BY total_value DESC, o_custkey LIMIT 10""")(
    lambda spark, d: _t(spark, d, "orders").groupBy("o_custkey")
    .agg(F.round(F.sum("o_totalprice"), 2).alias("total_value"))
    .orderBy(c("total_value").desc(), c("o_custkey")).limit(10))

register("flt_13_read_page", f"""WITH s14 AS ({Q.SCENARIO_SQL['S14'].strip()})
SELECT sfdc_account_id, account_name, days_to_renewal, risk_tier FROM s14 WHERE risk_tier = 'RED'
ORDER BY days_to_renewal, sfdc_account_id LIMIT 20 OFFSET 5""")(
    lambda spark, d: page(S.scn_14(roles(spark, d), ORDERS_AS_OF), c("risk_tier") == "RED",
                          [c("days_to_renewal").asc_nulls_last(), c("sfdc_account_id")], 20, 5,
                          ["sfdc_account_id", "account_name", "days_to_renewal", "risk_tier"]))

# SRT-02: mixed directions, NULLs high; a top-k report.
register("srt_02_mixed_order", f"""WITH s14 AS ({Q.SCENARIO_SQL['S14'].strip()})
SELECT sfdc_account_id, risk_tier, arr, days_to_renewal FROM s14
ORDER BY CASE risk_tier WHEN 'RED' THEN 1 WHEN 'AMBER' THEN 2 ELSE 3 END, arr DESC NULLS FIRST, sfdc_account_id
LIMIT 40""")(
    lambda spark, d: page(S.scn_14(roles(spark, d), ORDERS_AS_OF), None, [
        S.risk_severity(), c("arr").desc_nulls_first(), c("sfdc_account_id")], 40, 0,
        ["sfdc_account_id", "risk_tier", "arr", "days_to_renewal"]))

# SRT-01: a mart's default order, cut to its first rows.
register("srt_01_default_order", f"""WITH s11 AS ({Q.SCENARIO_SQL['S11'].strip()})
SELECT sfdc_account_id, account_name, days_to_renewal, dormancy_pct FROM s11
ORDER BY days_to_renewal, dormancy_pct DESC, sfdc_account_id, account_name LIMIT 40""")(
    lambda spark, d: page(S.scn_11(roles(spark, d), ORDERS_AS_OF), None, [
        *default_order("S11"), c("sfdc_account_id"), c("account_name")], 40, 0,
        ["sfdc_account_id", "account_name", "days_to_renewal", "dormancy_pct"]))

# ------------------------------------------------------------------- scalars

register("fn_02_day_diff", f"""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), {O}) AS INTEGER)
  AS days_since_order FROM orders""")(
    lambda spark, d: _t(spark, d, "orders").select("o_orderkey",
                                                   day_diff("o_orderdate", ORDERS_AS_OF).alias("days_since_order")))

register("fn_04_try_to_date", f"""SELECT account_id, event_time, {Q.td('event_time')} AS event_date
FROM rc_events""")(
    lambda spark, d: roles(spark, d).rc_events.select("account_id", "event_time",
                                                      parse_date("event_time").alias("event_date")))

register("fn_05_06_08_calendar", """SELECT o_orderkey,
  CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month_start,
  last_day(CAST(o_orderdate AS DATE)) AS month_end,
  CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
  make_date(year(o_orderdate), 12, 31) AS year_end,
  CAST(dayofweek(o_orderdate) AS INTEGER) AS day_of_week,
  dayofweek(o_orderdate) IN (0, 6) AS is_weekend
FROM orders""")(
    lambda spark, d: (lambda o: o.select(
        "o_orderkey", F.trunc(o.o_orderdate.cast("date"), "month").alias("month_start"),
        F.last_day(o.o_orderdate.cast("date")).alias("month_end"),
        quarter_end(o.o_orderdate.cast("date")).alias("quarter_end"),
        year_end(o.o_orderdate.cast("date")).alias("year_end"),
        (F.dayofweek("o_orderdate") - 1).alias("day_of_week"),
        F.dayofweek("o_orderdate").isin(1, 7).alias("is_weekend")))(_t(spark, d, "orders")))

register("fn_09_concat_key", """SELECT customerid, 'platform:' || webid AS telemetry_key FROM license_customer""")(
    lambda spark, d: roles(spark, d).license_customer.select("customerid",
                                                             telemetry_key("webid").alias("telemetry_key")))
