"""Identity of accounts across both bridge paths (BRG-01, BRG-03).

Accounts that share a telemetry id, by webid or by legacy id, are one customer
in the product's eyes; through a chain of shared ids whole groups are. The
groups are the connected components of accounts and ids. Every account carries
a label, at first its own id. A round gives every id the smallest label of its
accounts, every account the smallest of its ids, and every label the label of
the account that it names, so that labels travel along chains in ever longer
steps. Rounds end when no label changes.

An id that very many accounts share (a default value) is no hot task: minima
are combined before the shuffle, and where they are looked up again the rows
of such ids meet a broadcast of their few minima instead of being shuffled to
one place (``lookup``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import not_deleted
from tidemark.operators.bridge import telemetry_bridge
from tidemark.publish import files
from tidemark.session import checkpoint_dir
from tidemark.sources.registry import Sources

c = F.col
# Rows of one key from which on it is hot. Of n rows at most n / HOT_ROWS keys
# are: that bounds what is broadcast.
HOT_ROWS = 100_000


def lookup(rows: DataFrame, key: str, table: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``. Keys with
    ``hot_rows`` rows or more are looked up in a broadcast of their table rows,
    at most one per ``hot_rows`` rows of ``rows``; all others by a shuffle."""
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") >= hot_rows).select(key)
    hot_table = F.broadcast(table.join(hot, key, "left_semi"))
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    return rest.join(table, key).unionByName(rows.join(hot_table, key))


def clusters(links: DataFrame, entity: str, identifier: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(entity, cluster): the smallest entity reachable over shared
    identifiers, for every entity that has one. Links with a null end are
    dropped; each round's labels are written to the shared store and the last
    round's removed, so a lost executor costs one round."""
    spark = links.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-identity-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    edges = written(links.select(c(entity).alias("entity"), c(identifier).alias("identifier"))
                    .filter("entity IS NOT NULL AND identifier IS NOT NULL").distinct(), "edges")
    labels = written(edges.select("entity", c("entity").alias("label")).distinct(), "labels-0")
    state, n = None, 0
    while True:
        of_id = (lookup(edges, "entity", labels, hot_rows).groupBy("identifier").agg(F.min("label").alias("label")))
        of_entity = lookup(edges, "identifier", of_id, hot_rows).groupBy("entity").agg(F.min("label").alias("label"))
        near = written(of_entity, f"near-{n}")
        jump = near.select(c("entity").alias("label"), c("label").alias("farther"))
        labels = written(lookup(near, "label", jump, hot_rows).select("entity", c("farther").alias("label")),
                         f"labels-{n + 1}")
        for old in (f"labels-{n}", f"near-{n}"):
            files.delete(spark, f"{root}/{old}")
        n += 1
        now = labels.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("entity", "label"))).first()
        if now == state:
            return labels.select(c("entity").alias(entity), c("label").alias("cluster"))
        state = now


def account_identities(src: Sources) -> DataFrame:
    """One row per live account: sfdc_account_id, cluster_id (its smallest
    account; its own id where it shares none), cluster_accounts,
    cluster_telemetry_ids, path (webid, legacy, both or none: how the account
    itself reaches telemetry ids), conflict (its cluster has other accounts)
    and paths_disagree (it has ids on both paths, none of them in common)."""
    bridge = telemetry_bridge(src, ("webid", "legacy")).select("sfdc_account_id", "telemetry_account_id", "path")
    found = clusters(bridge, "sfdc_account_id", "telemetry_account_id")
    per_id = (bridge.groupBy("sfdc_account_id", "telemetry_account_id")
              .agg(F.max((c("path") == "webid").cast("int")).alias("w"), F.max((c("path") == "legacy").cast("int")).alias("l")))
    own = per_id.groupBy("sfdc_account_id").agg(F.max("w").alias("w"), F.max("l").alias("l"),
                                                F.max(c("w") * c("l")).alias("common"))
    placed = found.withColumnRenamed("cluster", "cluster_id")
    ids = (lookup(per_id.select("sfdc_account_id", "telemetry_account_id"), "sfdc_account_id", placed)
           .select("cluster_id", "telemetry_account_id").distinct()
           .groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_telemetry_ids")))
    sizes = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_accounts")).join(ids, "cluster_id")
    members = lookup(placed, "cluster_id", sizes).join(own, "sfdc_account_id")
    live = src.account.filter(not_deleted()).select(c("id").alias("sfdc_account_id")).distinct()
    path = (F.when((c("w") == 1) & (c("l") == 1), "both").when(c("w") == 1, "webid").when(c("l") == 1, "legacy")
            .otherwise("none"))
    return live.join(members, "sfdc_account_id", "left").select(
        "sfdc_account_id", F.coalesce("cluster_id", "sfdc_account_id").alias("cluster_id"),
        F.coalesce("cluster_accounts", F.lit(1)).alias("cluster_accounts"),
        F.coalesce("cluster_telemetry_ids", F.lit(0)).alias("cluster_telemetry_ids"), path.alias("path"),
        (F.coalesce("cluster_accounts", F.lit(1)) > 1).alias("conflict"),
        F.coalesce((c("w") == 1) & (c("l") == 1) & (c("common") == 0), F.lit(False)).alias("paths_disagree"))
