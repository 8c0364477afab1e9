"""Identity bridge between telemetry and CRM accounts (BRG-01..03).

Two join paths exist: licensing customer ``webid`` (CRM id via
``salesforceid``) and the CRM account's own ``platform_legacy_id_c``. Both
build the key ``platform:{id}``; a NULL id gives a NULL key, which never
joins. Coverage is partial, so every consumer should report it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import not_deleted, pct, telemetry_key
from tidemark.operators.kernels import distinct_entities
from tidemark.sources.registry import Sources

c = F.col
PATHS = ("webid", "legacy")


def telemetry_bridge(src: Sources, paths=("webid",)) -> DataFrame:
    """(sfdc_account_id, telemetry_account_id, licensing_customer_id, path).

    ``webid``: live account ⋈ live licensing customer on ``salesforceid``
    (the master view's bridge). ``legacy``: the account's legacy platform id.
    Rows with a NULL key are dropped — they can never match.
    """
    acct = src.account.filter(not_deleted())
    parts = []
    if "webid" in paths:
        cu = src.license_customer.filter(not_deleted())
        parts.append(acct.select(c("id").alias("sfdc_account_id"))
                     .join(cu, c("salesforceid") == c("sfdc_account_id"))
                     .select("sfdc_account_id", telemetry_key("webid").alias("telemetry_account_id"),
                             c("customerid").alias("licensing_customer_id"),
                             F.lit("webid").alias("path")))
    if "legacy" in paths:
        parts.append(acct.select(c("id").alias("sfdc_account_id"),
                                 telemetry_key("platform_legacy_id_c").alias("telemetry_account_id"),
                                 F.lit(None).cast("long").alias("licensing_customer_id"),
                                 F.lit("legacy").alias("path")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(c("telemetry_account_id").isNotNull())


def telemetry_accounts(src: Sources) -> DataFrame:
    """Distinct telemetry account ids seen in product events (RC ∪ IL)."""
    return (src.rc_events.select("account_id").unionByName(src.il_events.select("account_id"))
            .filter(c("account_id").isNotNull()).distinct())


def bridge_coverage(src: Sources, paths=PATHS) -> DataFrame:
    """Per path: live CRM accounts whose bridge key occurs in product telemetry.

    Columns: path, matched_accounts, total_accounts, match_pct, message.
    """
    acct = (src.account.filter(not_deleted()).select(c("id").alias("sfdc_account_id"))
            .withColumn("path", F.explode(F.array(*[F.lit(p) for p in paths]))))
    keys = telemetry_bridge(src, paths).select(c("sfdc_account_id").alias("_bid"),
                                               c("path").alias("_bpath"), "telemetry_account_id")
    seen = telemetry_accounts(src).withColumnRenamed("account_id", "_seen")
    j = (acct.join(keys, (c("_bid") == c("sfdc_account_id")) & (c("_bpath") == c("path")), "left")
         .join(seen, c("telemetry_account_id") == c("_seen"), "left"))
    counts = distinct_entities(j, "path", "sfdc_account_id",
                               {"total_accounts": F.lit(True), "matched_accounts": c("_seen").isNotNull()})
    return counts.select(
        "path", "matched_accounts", "total_accounts",
        pct("matched_accounts", "total_accounts").alias("match_pct"),
        F.format_string("%d of %d accounts matched via %s (%.1f%%)", c("matched_accounts"),
                        c("total_accounts"), c("path"),
                        pct("matched_accounts", "total_accounts")).alias("message"))


def bridge_orphans(src: Sources, paths=PATHS) -> DataFrame:
    """Bridge problems, long form: (path, issue, key, n).

    * ``telemetry_unmatched`` — telemetry account with no CRM account (n = 0);
    * ``key_multi_account`` — one telemetry key reaching several CRM accounts
      (n = accounts), the fan-out that duplicates master memberships;
    * ``account_unmatched`` — live CRM account without product telemetry on
      that path (n = 0).
    """
    b = telemetry_bridge(src, paths)
    seen = telemetry_accounts(src)
    per_path = seen.withColumn("path", F.explode(F.array(*[F.lit(p) for p in paths])))
    unmatched = (per_path.join(b.select(c("telemetry_account_id").alias("_k"), c("path").alias("_p")),
                               (c("_k") == c("account_id")) & (c("_p") == c("path")), "left_anti")
                 .select("path", F.lit("telemetry_unmatched").alias("issue"),
                         c("account_id").alias("key"), F.lit(0).cast("long").alias("n")))
    multi = (b.groupBy("path", "telemetry_account_id")
             .agg(F.count_distinct("sfdc_account_id").alias("n")).filter(c("n") > 1)
             .select("path", F.lit("key_multi_account").alias("issue"),
                     c("telemetry_account_id").alias("key"), "n"))
    used = (b.join(seen, c("telemetry_account_id") == c("account_id"), "left_semi")
            .select(c("sfdc_account_id").alias("_k"), c("path").alias("_p")))
    accounts = (src.account.filter(not_deleted()).select("id")
                .withColumn("path", F.explode(F.array(*[F.lit(p) for p in paths])))
                .join(used, (c("_k") == c("id")) & (c("_p") == c("path")), "left_anti")
                .select("path", F.lit("account_unmatched").alias("issue"), c("id").alias("key"),
                        F.lit(0).cast("long").alias("n")))
    return unmatched.unionByName(multi).unionByName(accounts)
