"""Rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair draws a hash; the shard with the smallest exponential
race time ``-ln(u) / weight`` takes the key. A shard's times do not depend on
the other shards, so a new shard only takes rows that it wins itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one task numbers at a time.
ROWS_PER_BLOCK = 65_536


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key; shard j has ``weights[j]`` (positive). A null
    key is a key of its own."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(j).alias("shard"), F.lit(float(w)).alias("weight"))
                       for j, w in enumerate(weights)])

    def race(s):
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00")),
                                               s["shard"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
        return F.struct((-F.ln(u) / s["weight"]).alias("time"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, race))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id",
          text_col: str = "text", grown: Sequence[float] | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard.

    The id and the weights alone decide the shard, so repeated ids share one.
    ``size`` is the text's UTF-8 bytes plus 1 and a null text counts as empty.
    ``slot`` numbers the rows of each shard from 0 without a gap; repeated
    rows take neighbouring slots. ``grown_shard`` is the shard under the
    weights ``grown`` (null without). An empty table gives no rows; further
    columns are ignored.

    Slots: rows fall into blocks by a hash of the id, equal rows are counted
    first (a key with a third of all rows is one row per task then), blocks
    are numbered by a running sum over their counts, rows inside their block.
    """
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    blocks = max(1, math.ceil(docs.count() / (ROWS_PER_BLOCK * len(weights))))
    rows = (docs.select(
        key.alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), rendezvous(key, weights).alias("shard"),
        F.pmod(F.xxhash64(key.cast("string"), F.lit("block")), F.lit(blocks)).alias("_block"))
        .groupBy("_id", "size", "text_crc32", "shard", "_block").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
             .select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first")))
    inside = (Window.partitionBy("shard", "_block").orderBy("_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    grown_shard = rendezvous(F.col("_id"), grown) if grown else F.lit(None).cast("int")
    return (numbered.join(first, ["shard", "_block"])
            .withColumn("_at", F.col("_first") + F.col("_before"))
            .withColumn("slot", F.explode(F.expr("sequence(_at, _at + _n - 1)")))
            .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard",
                    F.col("slot").cast("long").alias("slot"), grown_shard.alias("grown_shard")))
