"""Incremental event rollups (STR-01..03).

The daily rollup — (surface, account, day, event name, session) → events, first
and last time — is what the telemetry scenarios aggregate (distinct sessions
included); maintaining it incrementally lets a refresh read a small table
instead of the raw log (``refresh.run_all(rollup=…)``).

Late data: the usage feed can lag by weeks, so a watermark would silently
drop rows. The incremental path therefore keeps no state in the stream:
each micro-batch's partial rollup is written to its own ``batch_id``
partition (dynamic partition overwrite, so a replayed batch replaces itself
— exactly-once in effect), and readers merge partials with one ``groupBy``
(sums and min/max are mergeable). ``compact`` folds them periodically: the
folded version is announced like a mart, and readers take it together with
the batches after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.dates import parse_date
from tidemark.publish import files
from tidemark.publish.publish import observed_write
from tidemark.publish.versions import NONE, clean, commit, latest

c = F.col
KEYS = ["surface", "account_id", "event_date", "tracked_event_name", "session_id"]


def daily_partials(events: DataFrame, surface: str | None = None) -> DataFrame:
    """Rollup of one batch (or a whole table) to the rollup grain."""
    ev = events if surface is None else events.withColumn("surface", F.lit(surface))
    if "session_id" not in ev.columns:
        ev = ev.withColumn("session_id", F.lit(None).cast("string"))
    # A month alone would cast to its first day: no time without a day.
    ts = F.when(parse_date("event_time").isNotNull(), c("event_time").try_cast("timestamp_ntz"))
    return (ev.withColumn("event_date", parse_date("event_time")).withColumn("_ts", ts)
            .groupBy(*KEYS)
            .agg(F.count(F.lit(1)).alias("events"),
                 F.min("_ts").alias("first_event_time"),
                 F.max("_ts").alias("last_event_time")))


def merge_partials(partials: DataFrame) -> DataFrame:
    """STR-03: fold partial rollups (any number per key) into one row per key."""
    return (partials.groupBy(*KEYS)
            .agg(F.sum("events").cast("long").alias("events"),
                 F.min("first_event_time").alias("first_event_time"),
                 F.max("last_event_time").alias("last_event_time")))


def event_daily_rollup(rc_events: DataFrame, il_events: DataFrame) -> DataFrame:
    """STR-01 (batch form): the full rollup of both product surfaces."""
    rc = rc_events.select("account_id", "tracked_event_name", "event_time", F.lit(None).cast("string").alias("session_id"),
                          F.lit("RC").alias("surface"))
    il = il_events.select("account_id", "tracked_event_name", "event_time", "session_id", F.lit("IL").alias("surface"))
    return daily_partials(rc.unionByName(il))


def start_incremental_rollup(spark: SparkSession, source_dir: str, schema, surface: str,
                             target: str, checkpoint: str) -> StreamingQuery:
    """STR-01/02: process every new file of ``source_dir`` once
    (``availableNow``), appending idempotent per-batch partials to
    ``<target>/partials``. Each surface has its own stream and partition."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (daily_partials(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("surface", "batch_id").parquet(f"{target}/partials"))

    return (stream.withColumn("surface", F.lit(surface)).writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _partials(spark: SparkSession, target: str) -> DataFrame:
    df = spark.read.parquet(f"{target}/partials")
    return df.withColumns({"surface": c("surface").cast("string"), "batch_id": c("batch_id").cast("long")})


def _numbers(spark: SparkSession, target: str) -> dict[str, list[int]]:
    """Batches that have partials, per surface: names of folders, no file."""
    def values(folder: str, column: str) -> list[str]:
        return [n[len(column) + 1:] for n in files.names(spark, folder) if n.startswith(f"{column}=")]

    return {s: sorted(int(b) for b in values(f"{target}/partials/surface={s}", "batch_id"))
            for s in values(f"{target}/partials", "surface")}


def _after(upto: dict[str, int]) -> Column:
    """Batches after those bounds, as literals: whole partitions are left out."""
    after = ~c("surface").isin(list(upto)) if upto else F.lit(True)
    for surface, n in upto.items():
        after = after | ((c("surface") == surface) & (c("batch_id") > n))
    return after


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The current rollup: the newest compacted version and all partials after
    it, merged. Partials that it holds are not read."""
    v = latest(spark, f"{target}/compacted")
    if v is None:
        return merge_partials(_partials(spark, target).drop("batch_id"))
    late = _partials(spark, target).filter(_after(v["upto"])).drop("batch_id")
    return merge_partials(spark.read.parquet(v["marts"]["rollup"]["path"]).unionByName(late))


def compact(spark: SparkSession, target: str, run_id: str) -> None:
    """Fold everything up to the present into one version and announce it
    (run between refreshes). Batches that arrive meanwhile stay partials. Those
    that the version before held already are removed, and so are the folders
    of the versions before it; its own readers still find all they need."""
    root = f"{target}/compacted"
    before = latest(spark, root)
    done = before["upto"] if before else {}
    upto = {**done, **{s: max(ids) for s, ids in _numbers(spark, target).items() if ids}}
    rows = _partials(spark, target).filter(_after(done) & ~_after(upto)).drop("batch_id")
    if before:
        rows = rows.unionByName(spark.read.parquet(before["marts"]["rollup"]["path"]))
    path = f"{root}/run_id={run_id}"
    n, _ = observed_write(merge_partials(rows), path, "rollup")
    commit(spark, root, run_id, {"rollup": {"path": path, "rows": n}}, before["version"] if before else NONE,
           facts={"upto": upto})
    for surface, ids in _numbers(spark, target).items():
        for batch in [b for b in ids if b <= done.get(surface, -1)]:
            files.delete(spark, f"{target}/partials/surface={surface}/batch_id={batch}")
    clean(spark, root)


def merge_milestones(state: DataFrame, batch: DataFrame, key: str | list[str],
                     ever_cols: list[str] = (), first_cols: list[str] = (),
                     last_cols: list[str] = (), sum_cols: list[str] = ()) -> DataFrame:
    """STR-03: ever-flags (max), first dates (min) and last dates (max) are
    monotone and counts add up, so stored state and a new batch merge by
    ``groupBy``; a batch's counts must come once (``streaming.state``)."""
    both = state.unionByName(batch, allowMissingColumns=True)
    return both.groupBy(*([key] if isinstance(key, str) else key)).agg(
        *[F.max(x).alias(x) for x in ever_cols], *[F.min(x).alias(x) for x in first_cols],
        *[F.max(x).alias(x) for x in last_cols], *[F.sum(x).alias(x) for x in sum_cols])


def restage_days(source: DataFrame, target: str, time_col: str, day_col: str,
                 touched: DataFrame) -> None:
    """STR-02: late data for a day-partitioned staged fact.

    ``touched`` holds the days (column ``day_col``) that late rows landed on —
    e.g. the distinct days of the latest raw batch, NULL for rows without a
    readable day. Those days are recomputed from the source and replaced with
    dynamic partition overwrite; every other day stays as it is. A touched day
    that has no row left is removed. Nothing is dropped for being late, and a
    rerun rewrites the same partitions (idempotent). A day of many rows is
    written by several tasks.

    The source is read once. Where it has the column ``day_col`` itself (a fact
    stored by day), its other days are not read at all. The touched days are
    gathered, a row per day.
    """
    from tidemark.sources.staging import by_day, day_of
    spark = source.sparkSession
    days = [d for d, in touched.select(F.col(day_col)).distinct().collect()]
    known = [d for d in days if d is not None]
    day = c(day_col) if day_col in source.columns else day_of(time_col, source)
    wanted = day.isin(known) if known else F.lit(False)
    if len(known) < len(days):
        wanted = wanted | day.isNull()
    folders = {d: f"{target}/{day_col}={d if d is not None else '__HIVE_DEFAULT_PARTITION__'}" for d in days}
    before = {d: set(files.names(spark, folder)) for d, folder in folders.items()}
    (by_day(source.filter(wanted).withColumn(day_col, day), day_col)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(target))
    for d, folder in folders.items():  # a day that kept its old files got no new ones
        if before[d] and set(files.names(spark, folder)) == before[d]:
            files.delete(spark, folder)
