"""Keyed change feed between two runs of a mart (QLT-06).

A run is stored by hash buckets of its keys, with a digest per bucket: rows,
and the sum and the exclusive or of the rows' hashes, which do not depend on
the order of rows. Two runs are compared digest by digest; buckets with equal
digests are not read again. In the others rows meet by key, and a row that is
in both with other values comes with the names of the columns that changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
BUCKETS = 64


def write_run(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Store a run under ``path``: its rows by bucket, and the digests. A row
    whose keys others share gets a number among them (in the order of all
    columns), so that such rows are compared one by one."""
    from pyspark.sql import Window
    names = df.columns
    twin = F.row_number().over(Window.partitionBy(*keys).orderBy(*[x for x in names if x not in keys], *keys))
    (df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_twin", twin)
     .repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows"))
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    h = F.xxhash64(*names, "_twin")
    (rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("either"),
                                 F.sum(h.cast("decimal(38,0)")).alias("total"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/digests"))


def unequal_buckets(spark: SparkSession, previous: str, current: str) -> list[int]:
    """Buckets whose digests differ or that only one run has."""
    def digests(path: str) -> dict:
        return {r["_bucket"]: tuple(r)[1:] for r in spark.read.parquet(f"{path}/digests")
                .select("_bucket", "rows", "either", "total").collect()}  # a row per bucket

    a, b = digests(previous), digests(current)
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def changes(spark: SparkSession, previous: str, current: str, keys: list[str]) -> DataFrame:
    """Rows (keys, change, changed_columns) of what differs between two stored
    runs: ``added``, ``removed``, or ``changed`` with the columns whose values
    differ (NULL and a value do). Columns that only one run has count as
    changed where they hold a value. Equal rows give nothing."""
    buckets = unequal_buckets(spark, previous, current)

    def rows(path: str) -> DataFrame:
        return spark.read.parquet(f"{path}/rows").filter(c("_bucket").isin(buckets) if buckets else F.lit(False))

    a, b = rows(previous), rows(current)
    by = [*keys, "_twin"]
    values = [x for x in dict.fromkeys([*a.columns, *b.columns]) if x not in (*by, "_bucket")]

    def side(df: DataFrame, mark: str) -> DataFrame:
        held = F.struct(*[(c(x) if x in df.columns else F.lit(None)).alias(x) for x in values])
        return df.select(*[c(k).alias(f"{mark}_{k}") for k in by], held.alias(mark))

    a, b = side(a, "a"), side(b, "b")
    met = a.join(b, reduce(lambda x, y: x & y, [a[f"a_{k}"].eqNullSafe(b[f"b_{k}"]) for k in by]), "full_outer")

    def differs(x: str) -> Column:
        return F.when(~c("a")[x].eqNullSafe(c("b")[x]), F.lit(x))

    names = F.filter(F.array(*[differs(x) for x in values]), lambda x: x.isNotNull())
    change = F.when(c("a").isNull(), "added").when(c("b").isNull(), "removed").when(F.size(names) > 0, "changed")
    return met.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], change.alias("change"),
                      F.when(change == "changed", names).otherwise(F.array().cast("array<string>")).alias("changed_columns")
                      ).filter("change IS NOT NULL")
