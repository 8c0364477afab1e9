"""Profiling and inventory (PRF-01..07).

Each profile is one aggregation pass per table (partial aggregation on every
task), reshaped to long form with ``stack`` so tables with different columns
union cleanly. Distinct counts are approximate (HyperLogLog, bounded memory)
unless ``exact=True``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def table_inventory(tables: dict[str, DataFrame], updated_col: dict[str, str] | None = None) -> DataFrame:
    """PRF-01: (table_name, row_count, column_count, last_update)."""
    updated_col = updated_col or {}
    parts = []
    for name, df in tables.items():
        last = (F.max(c(updated_col[name])).cast("timestamp_ntz") if name in updated_col
                else F.lit(None).cast("timestamp_ntz"))
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), last.alias("last_update"))
                     .select(F.lit(name).alias("table_name"), "row_count",
                             F.lit(len(df.columns)).alias("column_count"), "last_update"))
    return reduce(DataFrame.unionByName, parts)


def date_ranges(df: DataFrame, table: str) -> DataFrame:
    """PRF-02: min/max of every date or timestamp column, long form."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, DATE_TYPES)]
    aggs = []
    for n in cols:
        aggs += [F.min(c(n)).cast("timestamp_ntz").alias(f"min__{n}"),
                 F.max(c(n)).cast("timestamp_ntz").alias(f"max__{n}")]
    wide = df.agg(*aggs)
    body = ", ".join(f"'{n}', `min__{n}`, `max__{n}`" for n in cols)
    return wide.selectExpr(f"'{table}' AS table_name",
                           f"stack({len(cols)}, {body}) AS (column_name, min_value, max_value)")


def column_profile(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """PRF-03: per column — type, null count and distinct count (approximate
    within 5 % by default). Exact counts read one column at a time and count
    its groups, instead of repeating every row once per column."""
    fields = df.schema.fields
    if exact:
        return reduce(DataFrame.unionByName, [
            df.groupBy(c(f"`{f.name}`").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("row_count"),
                 F.coalesce(F.sum(F.when(c("_v").isNull(), c("_n"))), F.lit(0)).cast("long").alias("null_count"),
                 F.count("_v").alias("distinct_count"))
            .select(F.lit(table).alias("table_name"), "row_count", F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"), "null_count", "distinct_count")
            for f in fields])
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for f in fields:
        aggs += [F.count_if(c(f"`{f.name}`").isNull()).alias(f"nulls__{f.name}"),
                 F.approx_count_distinct(c(f"`{f.name}`")).alias(f"distinct__{f.name}")]
    wide = df.agg(*aggs)
    body = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', `nulls__{f.name}`, "
                     f"CAST(`distinct__{f.name}` AS BIGINT)" for f in fields)
    return wide.selectExpr(f"'{table}' AS table_name", "__rows AS row_count",
                           f"stack({len(fields)}, {body}) AS (column_name, data_type, null_count, "
                           f"distinct_count)")


def key_check(df: DataFrame, keys: list[str], name: str = "") -> DataFrame:
    """PRF-04 / PRF-07: does ``keys`` identify rows? One row:
    (name, rows, null_key_rows, duplicate_keys, duplicate_rows, is_unique)."""
    any_null = reduce(lambda a, b: a | b, [c(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(any_null.cast("int")).alias("_null"))
    out = per_key.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(c("_null") == 1, c("_n")).otherwise(0)).alias("null_key_rows"),
        F.count_if(c("_n") > 1).alias("duplicate_keys"),
        F.sum(F.when(c("_n") > 1, c("_n")).otherwise(0)).alias("duplicate_rows"))
    return out.select(F.lit(name).alias("name"), F.coalesce(c("rows"), F.lit(0)).cast("long").alias("rows"),
                      F.coalesce(c("null_key_rows"), F.lit(0)).cast("long").alias("null_key_rows"),
                      "duplicate_keys",
                      F.coalesce(c("duplicate_rows"), F.lit(0)).cast("long").alias("duplicate_rows"),
                      ((c("duplicate_keys") == 0) & (F.coalesce(c("null_key_rows"), F.lit(0)) == 0))
                      .alias("is_unique"))


def fk_check(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str,
             name: str = "") -> DataFrame:
    """PRF-05: inclusion of distinct child keys in the parent key set."""
    ck = child.select(c(child_key).alias("_k")).filter(c("_k").isNotNull()).distinct()
    pk = parent.select(c(parent_key).alias("_p")).filter(c("_p").isNotNull()).distinct()
    j = ck.join(pk, c("_k") == c("_p"), "left")
    out = j.agg(F.count(F.lit(1)).alias("child_keys"), F.count(c("_p")).alias("matched_keys"))
    return out.select(F.lit(name).alias("name"), "child_keys", "matched_keys",
                      (c("child_keys") - c("matched_keys")).alias("orphan_keys"),
                      F.round(c("matched_keys").cast("double") * 100.0
                              / F.nullif(c("child_keys"), F.lit(0)).cast("double"), 1).alias("inclusion_pct"))


def sample_rows(df: DataFrame, fraction: float, keys: list[str], salt: str = "",
                mask: list[str] | None = None) -> DataFrame:
    """PRF-06: the rows whose key's hash falls into the first ``fraction`` of
    its range — repeatable, no sort, and equal keys stay together. Personal
    columns are masked (with ``salt``)."""
    from tidemark.publish.publish import mask_columns
    key = F.concat_ws("|", F.lit(salt), *[c(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return mask_columns(df.filter(bits < int(fraction * 2 ** 32)), mask or [], salt=salt)
