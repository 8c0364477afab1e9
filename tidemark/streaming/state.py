"""STR-03: versioned milestone state per account, updated by key.

The state of a surface (RC, IL) is the first level of its profile: a row per
account and value of the column whose distinct values the profile counts
(event names, sessions). So a set of sessions is rows, not an array, and a
very active account is spread like any other; flags, first and last dates
merge as maxima and minima, counts add up, and the distinct values of two
batches are the union of their rows.

A batch rewrites what it touches and nothing else. Its rows are merged with the
stored rows of the same keys and written as a *layer*, together with the
profiles of its accounts, both stored by a hash bucket of the account, so that
only the buckets of the batch's accounts are read. Of several layers the newest
row of a key holds. Layers are folded into one when there are many.

Layers and the batches they hold are announced in a version log, so a batch
counts once, however often and in whichever order batches come; two updates at
once are put one after the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.kernels import Spec, milestone_parts, milestone_totals
from tidemark.plans.telemetry import PROFILES
from tidemark.publish.versions import NONE, ConcurrentRefresh, clean, commit, latest
from tidemark.streaming.rollup import merge_milestones

c = F.col
KEY = "account_id"
# Hash buckets of the accounts and layers before they are folded.
BUCKETS, MOST_LAYERS = 256, 12


def _bucket() -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def _columns(specs: dict[str, Spec], *kinds: str) -> list[str]:
    return [n for n, s in specs.items() if s.kind in kinds]


def _layers(version: dict | None, surface: str) -> list[str]:
    """Folders of a surface's layers, oldest first."""
    return [version["marts"][m]["path"] for m in version["layers"].get(surface, [])] if version else []


def _newest(spark: SparkSession, layers: list[str], part: str, keys: list[str],
            buckets: list[int] | None = None) -> DataFrame | None:
    """The newest row per key of a part (``detail``, ``accounts``) of the
    layers, of all buckets or the ones given (other folders are not read)."""
    if not layers:
        return None
    rows = None
    for k, path in enumerate(layers):
        own = spark.read.parquet(f"{path}/{part}").withColumn("_layer", F.lit(k))
        if buckets is not None:
            own = own.filter(c("bucket").isin(buckets))
        rows = own if rows is None else rows.unionByName(own)
    if len(layers) == 1:
        return rows.drop("_layer", "bucket")
    measures = [x for x in rows.columns if x not in (*keys, "_layer", "bucket")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*measures), "_layer").alias("_row"))
            .select(*keys, "_row.*"))


def read_profile(spark: SparkSession, root: str, surface: str) -> DataFrame:
    """The profile of a surface (``plans.telemetry``), a row per account."""
    found = _newest(spark, _layers(latest(spark, root), surface), "accounts", [KEY])
    if found is None:
        raise FileNotFoundError(f"no state of {surface} under {root}")
    return found


def holds(version: dict | None, surface: str, batch_id: int) -> bool:
    return any(lo <= batch_id <= hi for lo, hi in (version or {}).get("batches", {}).get(surface, []))


def _with_batch(spans: list[list[int]], batch_id: int) -> list[list[int]]:
    """Spans of batch numbers, with one more number; neighbours join."""
    out: list[list[int]] = []
    for lo, hi in sorted([*spans, [batch_id, batch_id]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _write(df: DataFrame, path: str) -> None:
    df.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)


def apply_batch(spark: SparkSession, root: str, surface: str, batch_id: int, events: DataFrame,
                day: Column | None = None, weight: Column | None = None) -> bool:
    """Merge a batch of events (or of rollup rows, with their ``day`` and
    ``weight``) into the state. False if the batch was merged before."""
    make_specs, value = PROFILES[surface]
    specs = make_specs(day, weight)
    keys = [KEY, value]
    version = latest(spark, root)
    if holds(version, surface, batch_id):
        return False
    path = f"{root}/{surface}/run_id={uuid.uuid4().hex}"
    milestone_parts(events, KEY, specs, value).write.parquet(f"{path}/batch")
    batch = spark.read.parquet(f"{path}/batch")
    touched = sorted(b for b, in batch.select(_bucket()).distinct().collect())  # at most BUCKETS
    while True:
        layer = f"{path}/{uuid.uuid4().hex}"
        detail = _newest(spark, _layers(version, surface), "detail", keys, touched)
        if detail is None:
            merged = batch
        else:
            same = [detail[k].eqNullSafe(batch[k]) for k in keys]
            merged = merge_milestones(
                detail.join(batch, same, "left_semi"), batch, keys, _columns(specs, "ever", "distinct"),
                _columns(specs, "first"), _columns(specs, "last"), _columns(specs, "count"))
        _write(merged.select(*keys, *specs), f"{layer}/detail")
        now = _newest(spark, [*_layers(version, surface), layer], "detail", keys, touched)
        accounts = batch.select(c(KEY).alias("_k")).distinct()
        own = now.join(accounts, now[KEY].eqNullSafe(c("_k")), "left_semi")
        _write(milestone_totals(own, KEY, specs, value), f"{layer}/accounts")
        try:
            _announce(spark, root, surface, layer, version, add=batch_id)
            break
        except ConcurrentRefresh:  # merge on top of what came first
            version = latest(spark, root)
            if holds(version, surface, batch_id):
                return False
    if len(_layers(latest(spark, root), surface)) > MOST_LAYERS:
        fold(spark, root, surface)
    return True


def _announce(spark: SparkSession, root: str, surface: str, layer: str, version: dict | None,
              add: int | None = None, instead: bool = False) -> None:
    """A version with one layer more, or with it instead of the surface's."""
    name = f"{surface}-{layer.rsplit('/', 1)[1]}"
    layers, batches = dict((version or {}).get("layers", {})), dict((version or {}).get("batches", {}))
    old = layers.get(surface, [])
    layers[surface] = [name] if instead else [*old, name]
    if add is not None:
        batches[surface] = _with_batch(batches.get(surface, []), add)
    commit(spark, root, name, {name: {"path": layer}}, version["version"] if version else NONE,
           {"layers": layers, "batches": batches}, drop=set(old) if instead else set())


def fold(spark: SparkSession, root: str, surface: str) -> None:
    """One layer instead of many; folders that no kept version has are removed.
    Loses to an update that comes first, and is then left to the next one."""
    make_specs, value = PROFILES[surface]
    version = latest(spark, root)
    layers = _layers(version, surface)
    if len(layers) < 2:
        return
    layer = f"{root}/{surface}/run_id={uuid.uuid4().hex}"
    _write(_newest(spark, layers, "detail", [KEY, value]), f"{layer}/detail")
    _write(_newest(spark, layers, "accounts", [KEY]), f"{layer}/accounts")
    try:
        _announce(spark, root, surface, layer, version, instead=True)
    except ConcurrentRefresh:
        return
    clean(spark, root)


def state_profiles(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The event profiles of a refresh, from the state."""
    return {"rc": read_profile(spark, root, "RC"), "il": read_profile(spark, root, "IL")}
