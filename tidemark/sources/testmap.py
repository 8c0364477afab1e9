"""Source roles derived from the driver's test tables.

The test tables (TPC-H-like plus an event stream) carry no CRM or telemetry
domain, so each role is a projection of one of them:

=================  ==========================================================
role               derivation
=================  ==========================================================
account            ``customer``; id = '001' + zero-padded c_custkey
license_customer   ``customer``; webid NULL for HOUSEHOLD (partial bridge); every fifth
                   belongs to its neighbour's account, so accounts have none, one
                   or two; names shared in a group; some webids are shared
user (CSMs)        ``nation``
contract           ``orders``; O → Activated, F → Expired, P → Draft; 1 in 50 deleted
opportunity        ``orders``; F → Closed Lost; 1 in 40 deleted
onboarding         ``orders`` with status P
license_key        ``lineitem ⋈ orders``; one key per line item; line 7 deleted
license_usage      ``lineitem ⋈ orders``; one validation per line item, those of a
                   quarter of the customers moved into one season
login              ``orders``: (platform:o_custkey, order day)
rc_events          ``events`` of type view / click, named by value band
il_events          all ``events`` of type signup / purchase / error, named by value
                   band (the highest signups have no name); every sixth user's
                   events belong to the next user, a quarter of the users had
                   theirs in 2001; times: a few junk, blank, partial, slashed
=================  ==========================================================

Orders span 1995-01-01..2001-08-01 and events 2024-01-01..01-30, hence the
two anchors below. The same mapping is written independently as DuckDB SQL in
``tidemark.registry.oracle`` for the correctness check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.functions.predicates import telemetry_key
from tidemark.sources.registry import Sources

ORDERS_AS_OF = dt.date(2001, 8, 2)
EVENTS_AS_OF = dt.date(2024, 1, 31)
RENEWAL_ANCHOR = dt.date(2001, 8, 2)
CANCELLATION_DAY = dt.date(2001, 6, 30)
SEASON_START = dt.date(2001, 8, 25)
# A quarter of the users had their IL events so many days earlier.
IL_SHIFT_DAYS = 8230

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The tables behind each role.
ROLE_TABLES = {
    "account": ("customer",), "license_customer": ("customer",), "user": ("nation",), "contract": ("orders",),
    "opportunity": ("orders",), "onboarding": ("orders",), "license_key": ("lineitem", "orders"),
    "license_usage": ("lineitem", "orders"), "login": ("orders",), "rc_events": ("events",), "il_events": ("events",),
}


# Columns of the test tables that the roles and jobs read: with a declared
# schema no file is opened while a plan is built.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _crm_id(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 15, "0"))


def _account(table) -> DataFrame:
    bal, seg, ck = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_custkey")
    return table("customer").select(
        _crm_id("001", ck).alias("id"),
        F.col("c_name").alias("name"),
        seg.alias("type"),
        F.when(F.col("c_nationkey") < 10, "Direct").otherwise("Partner").alias("channel_type__c"),
        F.when(seg == "BUILDING", "Angles Professional; Report Center")
         .when(seg == "MACHINERY", "ANGLES PROFESSIONAL")
         .otherwise("Angles Cloud").alias("active_product_lines_c"),
        F.when(bal < 0, F.lit(None).cast("string")).when(bal < 100, "")
         .otherwise(F.col("c_nationkey").cast("string")).alias("customer_success_associate_c"),
        ck.cast("string").alias("platform_legacy_id_c"),
        F.date_add(F.lit(RENEWAL_ANCHOR), (ck % 365).cast("int")).alias("next_renewal_date_c"),
        bal.alias("open_renewable_amount_c"),
        F.when(bal >= 5000, "A").when(bal >= 0, "B").otherwise("C").alias("customer_health_grade_c"),
        F.when(bal < 0, V.HEALTH_POOR).when(bal < 1500, V.HEALTH_AVERAGE).otherwise("Good")
         .alias("totango_totango_account_health_c"),
        (bal < 0).alias("at_risk_c"),
        (ck % 10).alias("open_support_cases_c"),
        F.when(seg == "AUTOMOBILE", "Cancelled").otherwise("Active").alias("contract_status_c"),
        F.when(seg == "AUTOMOBILE", F.lit(CANCELLATION_DAY)).alias("cancellation_date_c"),
        (bal > 9900).alias("_fivetran_deleted"),
    )


def _license_customer(table) -> DataFrame:
    seg, ck = F.col("c_mktsegment"), F.col("c_custkey")
    return table("customer").select(
        ck.alias("customerid"),
        F.when((ck % 10).isin(0, 9), F.concat(F.lit("Group "), F.floor((ck + 1) / 10).cast("string")))
         .otherwise(F.col("c_name")).alias("customername"),
        _crm_id("001", F.when((ck % 5 == 0) & (ck > 0), ck - 1).otherwise(ck)).alias("salesforceid"),
        F.when(seg == "HOUSEHOLD", F.lit(None).cast("string")).when(ck % 40 == 7, (ck + 1).cast("string"))
         .otherwise(ck.cast("string")).alias("webid"),
        (seg != "AUTOMOBILE").alias("onmaintenance"),
        (F.col("c_acctbal") > 9900).alias("_fivetran_deleted"),
    )


def _user(table) -> DataFrame:
    return table("nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lower(F.regexp_replace("n_name", " ", ".")), F.lit("@example.com")).alias("email"),
        (F.col("n_regionkey") == 4).alias("_fivetran_deleted"),
    )


def _contract(table) -> DataFrame:
    status = F.col("o_orderstatus")
    return table("orders").select(
        F.col("o_orderkey").alias("contract_id"),
        _crm_id("001", F.col("o_custkey")).alias("account_id"),
        F.when(status == "O", V.CONTRACT_ACTIVATED).when(status == "F", "Expired")
         .otherwise("Draft").alias("status"),
        F.col("o_orderdate").cast("date").alias("customer_signed_date"),
        (F.col("o_orderkey") % 50 == 3).alias("_fivetran_deleted"),
    )


def _opportunity(table) -> DataFrame:
    status = F.col("o_orderstatus")
    return table("orders").select(
        _crm_id("006", F.col("o_orderkey")).alias("id"),
        _crm_id("001", F.col("o_custkey")).alias("account_id"),
        F.when(status == "F", V.STAGE_CLOSED_LOST).when(status == "O", "Open")
         .otherwise("Closed Won").alias("stage_name"),
        F.col("o_orderdate").cast("date").alias("close_date"),
        F.col("o_orderpriority").alias("win_loss_reason_c"),
        F.when(F.col("o_totalprice") > 200000, "Price").otherwise("Fit").alias("win_loss_sub_reason_c"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), V.PRODUCT_LINE)
         .otherwise("Angles Cloud").alias("product_line_c"),
        (F.col("o_orderkey") % 40 == 5).alias("_fivetran_deleted"),
    )


def _onboarding(table) -> DataFrame:
    return table("orders").filter(F.col("o_orderstatus") == "P").select(
        _crm_id("001", F.col("o_custkey")).alias("account_c"),
        F.col("o_orderpriority").alias("stage_c"),
        F.lit("In Progress").alias("status_c"),
    )


def _lines(table) -> DataFrame:
    """Line items with their customer and user."""
    orders, user = table("orders").select("o_orderkey", "o_custkey"), F.col("l_suppkey").cast("string")
    return (table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("user_name", F.concat(F.lit("user"), user)))


def _license_key(table) -> DataFrame:
    ship_day = F.col("l_shipdate").cast("date")
    return _lines(table).select(
        F.col("o_custkey").alias("customerid"),
        F.col("user_name").alias("assigneduser"),
        F.concat("user_name", F.lit("@example.com")).alias("customeremail"),
        ship_day.alias("dateassigned"),
        F.when(F.col("l_returnflag") != "N", ship_day).alias("lastvalidateddate"),
        (F.col("l_linestatus") == "O").alias("registered"),
        F.when(F.col("l_returnflag") == "R", ship_day).alias("deactivated"),
        (F.col("l_linenumber") >= 7).alias("_fivetran_deleted"),
    )


def _license_usage(table) -> DataFrame:
    ship_day = F.col("l_shipdate").cast("date")
    # A quarter of the customers used the product in one season only, less and
    # less, so that short windows hold several users and some of them drop.
    turn = F.datediff(ship_day, F.lit(dt.date(1995, 1, 1))) % 71
    season = F.date_add(F.lit(SEASON_START), F.floor(turn * turn / 71).cast("int")).cast("timestamp_ntz")
    return _lines(table).select(
        F.col("o_custkey").alias("customerid"),
        F.col("user_name").alias("assigneduser"),
        F.when(F.col("o_custkey") % 4 == 3, season).otherwise(F.col("l_shipdate").cast("timestamp_ntz"))
         .alias("lastvalidateddate"),
    )


def _login(table) -> DataFrame:
    # Grain account + day; the rare repeated (customer, day) pair is kept —
    # every consumer is insensitive to duplicates (MAX / COUNT DISTINCT / anti join).
    return table("orders").select(telemetry_key("o_custkey").alias("account_id"),
                                  F.col("o_orderdate").cast("date").alias("date"))


def _event_time(ts):
    """Free text: a few are junk, blank, a month only, or have slashes."""
    val = F.col("value")
    return (F.when(val < 1, "not a date").when(val < 2, F.date_format(ts, "yyyy-MM")).when(val < 3, " ")
            .when(val < 4, F.date_format(ts, "MM/dd/yyyy")).otherwise(ts.cast("string")).alias("event_time"))


def _rc_events(table) -> DataFrame:
    et, val = F.col("event_type"), F.col("value")
    return table("events").filter(et.isin("view", "click")).select(
        telemetry_key("user_id").alias("account_id"),
        F.when(et == "view",
               F.when(val < 40, V.RC_HOME).when(val < 100, V.RC_UPLOAD_PAGE)
                .when(val < 160, V.RC_VIEW_ALL).otherwise(V.RC_SCHEDULE_PAGE))
         .otherwise(F.when(val < 60, V.RC_UPLOAD_CLICKED).when(val < 200, V.RC_LINEOS)
                    .otherwise(V.RC_SCHEDULE_CREATED)).alias("tracked_event_name"),
        _event_time(F.col("ts")),
    )


def _il_events(table) -> DataFrame:
    et, val = F.col("event_type"), F.col("value")
    user = F.col("user_id")
    il_time = F.col("ts") - F.make_dt_interval(F.when(user % 4 == 1, IL_SHIFT_DAYS).otherwise(0))
    return table("events").filter(et.isin("signup", "purchase", "error")).select(
        F.concat(F.lit(V.TELEMETRY_PREFIX), F.when(user % 6 == 0, user + 1).otherwise(user).cast("string"))
         .alias("account_id"),
        F.when(et == "signup", F.when(val < 60, V.IL_HOME).when(val < 200, V.IL_BUTTON))
         .when(et == "purchase",
               F.when(val < 60, V.IL_CREATE_RULE).when(val < 110, V.IL_SUBSCRIBERS)
                .otherwise(V.IL_SAVE_RULE))
         .otherwise(F.when(val < 20, V.IL_EDIT_RULE).when(val < 150, V.IL_DELETE_RULE)
                    .otherwise(V.IL_RESULTS)).alias("tracked_event_name"),
        _event_time(il_time),
        F.get_json_object("props", "$.k").alias("session_id"),
    )


BUILDERS = {
    "login": _login, "rc_events": _rc_events, "il_events": _il_events, "license_customer": _license_customer,
    "license_key": _license_key, "license_usage": _license_usage, "account": _account, "contract": _contract,
    "opportunity": _opportunity, "onboarding": _onboarding, "user": _user,
}


def roles(spark: SparkSession, sf_dir: str) -> Sources:
    """The roles of ``sf_dir``: lazy plans, each built when it is first used."""
    def table(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    return Sources(locations={r: tuple(f"{sf_dir}/{t}.parquet" for t in ts) for r, ts in ROLE_TABLES.items()},
                   **{r: lambda build=build: build(table) for r, build in BUILDERS.items()})


def arr_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ARR snapshots for the concept examples: one per order
    (account, order day, order key as snapshot id, total price as ARR);
    priority 5-LOW orders play the excluded 'Test' customers."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(_crm_id("001", F.col("o_custkey")).alias("account_id"),
                    F.col("o_orderdate").cast("date").alias("snapshot_date"),
                    F.col("o_orderkey").alias("snapshot_id"),
                    F.col("o_totalprice").alias("arr"),
                    F.when(F.col("o_orderpriority") == "5-LOW", "Test").otherwise("Customer")
                    .alias("customer_type"))
