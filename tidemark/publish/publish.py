"""Sinks, versioned publishing and reads (SNK-01..03, SRC-06, OPS-02..05, FLT-13).

Publishing never overwrites what readers use. A mart version is written to
its own folder (``<root>/<mart>/run_id=<id>``, or a refresh's run folder),
validated there, and only then announced as the next version of the root
(``publish.versions``). A whole refresh is one version, so its marts switch
together. Readers pick the newest version, so a crash between write and
announce leaves the previous one in service, and a half-written folder is
never read.
Marts are plain Parquet on the shared store; no local disk is used.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.publish import versions as VS

c = F.col


# ------------------------------------------------------------------- sinks

def write_mart(df: DataFrame, path: str, partition_by: list[str] | None = None,
               mode: str = "overwrite") -> None:
    """SNK-01: create-or-replace a mart as Parquet (full refresh)."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def observed_write(df: DataFrame, path: str, label: str, partition_by: list[str] | None = None
                   ) -> tuple[int, str]:
    """SNK-03: write and count in the same pass (an ``Observation``), and
    return ``(rows, "[S6] 39 accounts matched trigger")``."""
    obs = Observation(f"rows_{label}")
    write_mart(df.observe(obs, F.count(F.lit(1)).alias("rows")), path, partition_by)
    n = obs.get["rows"]
    return n, f"[{label}] {n} accounts matched trigger"


def export_csv(df: DataFrame, out_dir: str, name: str, as_of, order: list[Column] | None = None) -> str:
    """SNK-02: dated CSV export ``<out_dir>/<name>_YYYYMMDD`` with header.
    Written by all tasks in parallel; with ``order`` the part files are
    range-partitioned, so reading them in name order gives the sorted list."""
    day = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    path = f"{out_dir}/{name}_{day:%Y%m%d}"
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def dry_run(df: DataFrame, mode: str = "formatted") -> str:
    """SRC-06: the plan that would run, without running it."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


# ------------------------------------------------------- versioned publish

# Columns of ``versions``.
MANIFEST_SCHEMA = "mart string, run_id string, path string, rows long, published_at timestamp"


def publish(spark: SparkSession, df: DataFrame, root: str, mart: str,
            validate: Callable[[DataFrame], bool] | None = None, run_id: str | None = None,
            partition_by: list[str] | None = None) -> dict:
    """OPS-03: write aside → validate → announce. Returns the manifest row.

    ``validate`` receives the *written* data (read back from its folder) and
    must return True; otherwise nothing is announced and readers keep the
    previous version.
    """
    run_id = run_id or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{root}/{mart}/run_id={run_id}"
    rows, _ = observed_write(df, path, mart, partition_by)
    written = spark.read.parquet(path)
    if validate is not None and not validate(written):
        raise ValueError(f"validation failed for {mart} run {run_id}; not published")
    announce(spark, root, run_id, {mart: (path, rows)})
    return {"mart": mart, "run_id": run_id, "path": path, "rows": rows}


def announce(spark: SparkSession, root: str, run_id: str, marts: dict[str, tuple[str, int]],
             based_on: int | None = None) -> dict:
    """Publish already-written marts together as one version: all switch, or
    none does. ``based_on`` is the version that the refresh started from
    (``versions.commit``)."""
    return VS.commit(spark, root, run_id, {m: {"path": p, "rows": n} for m, (p, n) in marts.items()}, based_on)


def versions(spark: SparkSession, root: str, mart: str) -> DataFrame:
    """The announced versions of a mart that are still kept, newest first."""
    rows, seen = [], set()
    for n in reversed(VS.numbers(spark, root)):
        entry = (VS.read_version(spark, root, n) or {"marts": {}})["marts"].get(mart)
        if entry and entry["path"] not in seen:
            seen.add(entry["path"])
            rows.append((mart, entry["run_id"], entry["path"], entry["rows"],
                         dt.datetime.fromisoformat(entry["published_at"])))
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def compare_runs(spark: SparkSession, root: str, mart: str) -> DataFrame:
    """QLT-06 across refreshes: the newest announced version of a mart vs the
    one before it (row counts, rows added and removed)."""
    from tidemark.operators.quality import snapshot_diff
    top = versions(spark, root, mart).limit(2).collect()
    if len(top) < 2:
        raise ValueError(f"{mart} has fewer than two announced versions")
    return snapshot_diff(spark.read.parquet(top[1]["path"]), spark.read.parquet(top[0]["path"]))


def current_version(spark: SparkSession, root: str, mart: str, version: int | None = None) -> dict | None:
    """The mart's entry in the newest version, or in a given (pinned) one."""
    found = VS.latest(spark, root) if version is None else VS.read_version(spark, root, version)
    return dict(found["marts"][mart], mart=mart) if found and mart in found["marts"] else None


def read_mart(spark: SparkSession, root: str, mart: str, filters: Column | None = None,
              order_by: list[Column] | None = None, limit: int | None = None,
              offset: int = 0, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
    """OPS-04 / FLT-13: the app's read contract — filter, order, page; no
    aggregation. Filters reach the Parquet scan. Without ``order_by`` a mart
    comes in its default order (SRT-01/02); ``[]`` leaves it unordered.
    ``version`` reads an older (pinned) version instead of the newest."""
    v = current_version(spark, root, mart, version)
    if v is None:
        raise FileNotFoundError(f"{mart} has no published version under {root}")
    df = spark.read.parquet(v["path"])
    if order_by is None:
        order_by = default_order(mart)
    return page(df, filters, order_by, limit, offset, columns)


def default_order(mart: str) -> list[Column]:
    """Sort columns of a mart by table name or scenario id; none if it has no
    default order."""
    from tidemark.functions import vocabulary as V
    from tidemark.plans.scenarios import DEFAULT_ORDER, order_columns
    ids = {t: sid for sid, t in dict(V.MART_TABLES, MASTER=V.MASTER_TABLE).items()}
    return order_columns(DEFAULT_ORDER.get(ids.get(mart, mart), []))


def page(df: DataFrame, filters: Column | None = None, order_by: list[Column] | None = None,
         limit: int | None = None, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    if filters is not None:
        df = df.filter(filters)
    if order_by:
        df = df.orderBy(*order_by)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


# ------------------------------------------------------------- lineage, PII

def lineage(spark: SparkSession, depends_on: dict[str, list[str]], locations: dict[str, tuple[str, ...]]) -> DataFrame:
    """OPS-02: (mart, kind, name) — the tables each mart reads (those of its
    source roles, and of the marts it is built from) and what it is declared
    to depend on. No file is listed."""
    def tables(mart: str) -> set[str]:
        return {t for d in depends_on[mart] for t in (tables(d) if d in depends_on else locations.get(d, ()))}

    rows = [(m, "input_table", t) for m in depends_on for t in sorted(tables(m))]
    rows += [(m, "depends_on", d) for m, ds in depends_on.items() for d in ds]
    return spark.createDataFrame(rows, "mart string, kind string, name string")


def mask_columns(df: DataFrame, columns: list[str], method: str = "sha2", salt: str = "") -> DataFrame:
    """OPS-05: hash (``sha2``, joinable under one ``salt``) or mask (``mask``,
    readable shape) personal columns for exports and samples. Without a secret
    salt the hash of a guessable value can be reversed by guessing. A column
    that does not exist raises."""
    if missing := [col for col in columns if col not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    out = df
    for col in columns:
        text = c(col).cast("string")
        out = out.withColumn(col, F.sha2(F.concat(F.lit(salt), text), 256) if method == "sha2" else F.mask(text))
    return out
