"""Staging: one cleaned model per raw table (STG-01..08).

No joins, no aggregation, no business rules — only names, types, junk and
duplicates. Every function is a ``DataFrame -> DataFrame`` transformation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.dates import parse_date

c = F.col

TRUE_TEXT = ("1", "true", "t", "y", "yes")
FALSE_TEXT = ("0", "false", "f", "n", "no")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def canonical_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """STG-01: rename source columns (``acct_id`` → ``account_id``); other
    columns keep their lower-cased name."""
    lower = {k.lower(): v for k, v in mapping.items()}
    return df.select(*[c(f"`{n}`").alias(lower.get(n.lower(), n.lower())) for n in df.columns])


def blank_to_null(col) -> Column:
    """STG-08: whitespace-only or empty text → NULL."""
    col = c(col) if isinstance(col, str) else col
    return F.nullif(F.trim(col), F.lit(""))


def to_bool(col) -> Column:
    """STG-07: 0/1, 'TRUE'/'false', 'Y'/'N' … → BOOLEAN; anything else → NULL."""
    col = c(col) if isinstance(col, str) else col
    t = F.lower(F.trim(col.cast("string")))
    return F.when(t.isin(*TRUE_TEXT), True).when(t.isin(*FALSE_TEXT), False)


def parse_timestamp(col) -> Column:
    col = c(col) if isinstance(col, str) else col
    return F.coalesce(F.try_to_timestamp(col), *[F.try_to_timestamp(col, F.lit(f))
                                                 for f in TIMESTAMP_FORMATS])


CONVERTERS = {
    "date": parse_date,
    "iso_date": lambda x: parse_date(x, formats=()),
    "timestamp": parse_timestamp,
    "boolean": to_bool,
    "long": lambda x: F.col(x).try_cast("long") if isinstance(x, str) else x.try_cast("long"),
    "double": lambda x: F.col(x).try_cast("double") if isinstance(x, str) else x.try_cast("double"),
    "string": blank_to_null,
}


def normalize_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """STG-02: convert listed columns leniently (bad values → NULL)."""
    return df.select(*[CONVERTERS[types[n]](c(n)).alias(n) if n in types else c(n) for n in df.columns])


def _unreadable(col: str, kind: str) -> Column:
    """Whether a value is present, not blank, and fails to convert."""
    return c(col).isNotNull() & (F.trim(c(col).cast("string")) != "") & CONVERTERS[kind](c(col)).isNull()


def quarantine_counts(raw: DataFrame, types: dict[str, str], table: str) -> DataFrame:
    """STG-03: per column, values present in the raw table that fail to
    convert — (table, column, bad_values), one pass over the table."""
    wide = raw.agg(*[F.count_if(_unreadable(n, t)).alias(n) for n, t in types.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in types)
    return wide.selectExpr(f"'{table}' AS table_name",
                           f"stack({len(types)}, {stack}) AS (column_name, bad_values)")


def quarantine_rows(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """STG-03: the failing rows themselves, once per failing column, which
    ``failed_column`` names; one pass over the table."""
    failed = F.filter(F.array(*[F.when(_unreadable(n, t), F.lit(n)) for n, t in types.items()]), lambda x: x.isNotNull())
    return raw.select("*", F.explode(failed).alias("failed_column"))


def drop_junk(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """STG-04: split rows into (kept, dropped-with-reason). The first rule
    that matches names the reason."""
    reason = None
    for name, pred in rules.items():
        reason = F.when(pred, name) if reason is None else reason.when(pred, name)
    tagged = df.withColumn("_drop_reason", reason)
    return (tagged.filter(c("_drop_reason").isNull()).drop("_drop_reason"),
            tagged.filter(c("_drop_reason").isNotNull()).withColumnRenamed("_drop_reason", "drop_reason"))


def drop_soft_deleted(df: DataFrame, flag: str = "_fivetran_deleted") -> DataFrame:
    """STG-05: keep rows whose soft-delete flag is FALSE."""
    return df.filter(c(flag) == F.lit(False)) if flag in df.columns else df


def dedupe(df: DataFrame, keys: list[str], latest_by: list[Column] | None = None) -> DataFrame:
    """STG-06: one row per key — any row (``dropDuplicates``, partial on the
    map side) or the latest by ``latest_by`` (row_number = 1, which Catalyst
    runs as a WindowGroupLimit)."""
    if not latest_by:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*latest_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") == 1).drop("_rn")


def stage(df: DataFrame, names: dict[str, str] | None = None, types: dict[str, str] | None = None,
          keys: list[str] | None = None, junk: dict[str, Column] | None = None,
          dropped_to: str | None = None) -> DataFrame:
    """A whole staging model: names → soft deletes → types → junk → duplicates.
    Junk rows leave only with a record: ``dropped_to`` is the folder that takes
    the kept and the dropped rows (``stage_batch``), and is required where
    ``junk`` rules are given."""
    out = canonical_names(df, names or {})
    out = drop_soft_deleted(out)
    if junk:
        if not dropped_to:
            raise ValueError("junk rules need dropped_to, the folder for the dropped rows")
        out = staged(stage_batch(out, dropped_to, "all", types, junk))
    elif types:
        out = normalize_types(out, types)
    if keys:
        out = dedupe(out, keys)
    return out


def stage_batch(raw: DataFrame, root: str, batch: str, types: dict[str, str] | None = None,
                junk: dict[str, Column] | None = None) -> DataFrame:
    """STG-03/04: convert a batch of raw rows and write it once, kept and
    rejected rows together, each under its status: (converted columns, ``raw``,
    ``drop_reason``; status, batch). Returns what the folder then holds.

    A row is rejected for the first of the ``junk`` rules that matches (over
    the converted columns), or for a value that is present and cannot be
    converted (reason ``unreadable:<column>``); it keeps its raw values. A
    batch that is staged again replaces itself.
    """
    types = types or {}
    reason = None
    tests = {**(junk or {}), **{f"unreadable:{n}": c(f"raw.{n}").isNotNull() & (F.trim(c(f"raw.{n}").cast("string")) != "")
                                & c(n).isNull() for n in types}}
    for name, pred in tests.items():
        reason = F.when(pred, name) if reason is None else reason.when(pred, name)
    reason = F.lit(None).cast("string") if reason is None else reason
    converted = normalize_types(raw.withColumn("raw", F.struct(*raw.columns)), types)
    tagged = converted.withColumn("drop_reason", reason)
    kept = c("drop_reason").isNull()
    (tagged.withColumn("raw", F.when(~kept, c("raw")))
     .withColumns({"batch": F.lit(batch), "status": F.when(kept, "kept").otherwise("rejected")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").parquet(root))
    return raw.sparkSession.read.schema(tagged.schema.add("status", "string").add("batch", "string")).parquet(root)


def staged(batches: DataFrame) -> DataFrame:
    """The kept rows of a ``stage_batch`` folder."""
    return batches.filter(c("status") == "kept").drop("raw", "drop_reason", "status", "batch")


def replay(spark, root: str, schema, batch: str, types: dict[str, str] | None = None,
           junk: dict[str, Column] | None = None) -> DataFrame:
    """STG-03: stage the rejected rows of a ``stage_batch`` folder again, with
    rules and parsers of today, as the batch ``batch``: what can be read now is
    kept, the rest stays rejected under that batch. ``schema`` is that of the
    raw rows. Kept rows are not read. Repeated under the same name, also after
    a crash between its two steps, it leaves the same rows.
    """
    from tidemark.publish import files
    done = [n for n in files.names(spark, f"{root}/status=rejected") if n.startswith("batch=") and n != f"batch={batch}"]
    if done:
        old = (spark.read.schema(f"raw {schema.simpleString()}")
               .parquet(*[f"{root}/status=rejected/{n}" for n in sorted(done)]))
        stage_batch(old.select("raw.*"), root, batch, types, junk)
        for n in done:
            files.delete(spark, f"{root}/status=rejected/{n}")
    found = [f for f in spark.read.parquet(root).schema.fields if f.name not in ("status", "batch")]
    return spark.read.schema(StructType(found).add("status", "string").add("batch", "string")).parquet(root)


# Facts written partitioned by day when staging with ``partition_by_day``:
# role -> (time column, day-partition column).
DAY_PARTITIONED = {"license_usage": ("lastvalidateddate", "usage_day"), "login": ("date", "login_day"),
                   "rc_events": ("event_time", "event_day"), "il_events": ("event_time", "event_day")}


def day_of(col: str, df: DataFrame) -> Column:
    """The day of a time column: a cast for dates and timestamps, the lenient
    parser for free text (junk → NULL day, stored in the NULL partition)."""
    t = df.schema[col].dataType.simpleString()
    return parse_date(c(col)) if t == "string" else c(col).cast("date")


def by_day(df: DataFrame, day_col: str) -> DataFrame:
    """Rows of a day together for a write partitioned by day; Spark splits a
    day that is larger than its advisory size over several tasks and files."""
    return df.hint("rebalance", day_col)


def materialize_sources(spark, src, root: str, parallel: int = 4, partition_by_day: bool = False):
    """Write every source role once to ``<root>/<role>`` (Parquet, concurrent
    jobs) and return a ``Sources`` reading them with the declared schemas.

    A refresh then reads staged tables: roles defined as views over raw data
    (renames, type fixes, joins to derive keys) are computed once instead of
    once per consuming mart, and lineage is cut at the staging layer. With
    ``partition_by_day`` the usage, login and event facts are partitioned by
    day, so the scenarios' lookback windows prune partitions.
    """
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.sources.registry import Sources
    from tidemark.sources.schemas import SOURCE_SCHEMAS

    parts = DAY_PARTITIONED if partition_by_day else {}

    def write(item):
        name, df = item
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in SOURCE_SCHEMAS[name].fields])
        w = out.write.mode("overwrite")
        if name in parts:
            ts_col, day_col = parts[name]
            out = out.withColumn(day_col, day_of(ts_col, out))
            w = by_day(out, day_col).write.mode("overwrite").partitionBy(day_col)
        w.parquet(f"{root}/{name}")

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        list(pool.map(write, src.items()))
    return Sources.from_parquet(spark, root, day_partitions=parts)
