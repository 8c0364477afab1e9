"""Pages of a mart by key instead of by offset (FLT-13, OPS-04).

A mart is written sorted over its files, with a small index: for each file its
rows and its last key. The page after a key starts in the first file whose last
key lies behind it, so a page reads the files that hold it, whether it is the
first or the millionth, and nothing is sorted but the rows of these files.
NULLs sort high, as in the marts' default orders. The order must tell rows
apart: end it with the mart's key. ``pages_after`` gives all pages behind a key at
once: from the index it is known which rows of the mart a file holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
ROWS_PER_FILE = 50_000
Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc")


def write_sorted(df: DataFrame, path: str, order: Order, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write a mart sorted by ``order`` over files of at most ``rows_per_file``
    rows, and its index under ``<path>/_index`` (a row per file)."""
    from tidemark.plans.scenarios import order_columns
    by = order_columns(order)
    (df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).parquet(path))
    spark = df.sparkSession
    place = F.col("_metadata.file_path")
    # part-00003-...-c001: the task's number and the file's number in the task.
    task, file = (F.regexp_extract(place, p, 1).cast("long") for p in (r"part-(\d+)-", r"-c(\d+)\.[^/]*$"))
    last = F.max_by(F.struct(*[c(n) for n, _ in order]), c("_metadata.row_index"))
    (spark.read.parquet(path).groupBy(place.alias("file"), task.alias("task"), file.alias("number"))
     .agg(F.count(F.lit(1)).alias("rows"), last.alias("last"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/_index"))


def behind(order: Order, key: Sequence, columns: Sequence[Column] | None = None) -> Column:
    """Whether a row comes after ``key`` (its values, in the order's columns)."""
    columns = columns or [c(n) for n, _ in order]
    after, same = F.lit(False), F.lit(True)
    for col, (_, way), v in zip(columns, order, key, strict=True):
        if v is None:  # the highest value
            further, equal = (F.lit(False) if way == "asc" else col.isNotNull()), col.isNull()
        else:
            further, equal = ((col > F.lit(v)) | col.isNull() if way == "asc" else col < F.lit(v)), col == F.lit(v)
        after, same = after | (same & F.coalesce(further, F.lit(False))), same & F.coalesce(equal, F.lit(False))
    return after


def files_after(spark: SparkSession, path: str, order: Order, key: Sequence | None = None) -> list[Row]:
    """Index rows (file, rows) that can hold rows after ``key``, in order."""
    index = spark.read.parquet(f"{path}/_index")
    if key is not None:
        index = index.filter(behind(order, key, [c(f"last.{n}") for n, _ in order]))
    return index.select("file", "rows", "task", "number").orderBy("task", "number").collect()  # a row per file


def page_after(spark: SparkSession, path: str, order: Order, limit: int, after: Sequence | None = None,
               filters: Column | None = None) -> list[Row]:
    """The ``limit`` rows that follow the key ``after`` (the values of the
    order's columns in the last row of the page before; None: the first page).
    With ``filters`` as many further files are read as the page needs."""
    from tidemark.plans.scenarios import order_columns
    left, found, step = files_after(spark, path, order, after), [], 0
    # Of one file: a page costs the same however many files the mart has.
    schema = spark.read.parquet(left[0].file).schema if left else None
    while left and len(found) < limit:
        rows, take = 0, []
        # The first file may hold only one row behind the key.
        while left and (not take or rows < limit + (0 if step else take[0].rows)) and len(take) < max(2, step):
            take.append(left.pop(0))
            rows += take[-1].rows if filters is None else 0
        part = spark.read.schema(schema).parquet(*[f.file for f in take])
        if after is not None:
            part = part.filter(behind(order, after))
        if filters is not None:
            part = part.filter(filters)
        found += part.orderBy(*order_columns(order)).limit(limit - len(found)).collect()
        step = max(4, 2 * step)
    return found


def pages_after(spark: SparkSession, path: str, order: Order, limit: int, after: Sequence | None = None) -> DataFrame:
    """All pages of ``limit`` rows that follow the key ``after``, at once: the
    rows with their ``page`` and their ``place`` in it, both from 0, as
    ``page_after`` gives them one page after the other. A row's number is the
    rows of the files before its own plus its place there, so the files are
    read side by side, each once; nothing is sorted or passes the driver."""
    index = spark.read.parquet(f"{path}/_index").select("file", "task", "number", "rows", "last")
    before = lambda by: F.coalesce(F.sum("rows").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = (index.groupBy(c("task").alias("_task")).agg(F.sum("rows").alias("rows"))  # a row per task of the write
             .select("_task", before(Window.orderBy("_task")).alias("_tasks_before")))
    starts = (index.join(tasks, c("task") == c("_task"))
              .withColumn("_start", c("_tasks_before") + before(Window.partitionBy("task").orderBy("number"))))
    rows = spark.read.parquet(path)
    names, skipped = rows.columns, 0
    rows = rows.select(*names, c("_metadata.file_path").alias("_path"), c("_metadata.row_index").alias("_row"))
    if after is not None:
        starts = starts.filter(behind(order, after, [c(f"last.{n}") for n, _ in order]))
        rows = rows.filter(behind(order, after))
        if first := files_after(spark, path, order, after)[:1]:  # only this file has rows on both sides of the key
            skipped = (starts.agg(F.min("_start")).first()[0]
                       + first[0].rows - spark.read.parquet(first[0].file).filter(behind(order, after)).count())
    number = c("_start") + c("_row") - F.lit(skipped)
    return (rows.join(starts.select(c("file").alias("_file"), "_start"), c("_path") == c("_file"))
            .select(F.floor(number / limit).cast("int").alias("page"), (number % limit).cast("int").alias("place"), *names))


def key_of(row: Row, order: Order) -> tuple:
    return tuple(row[n] for n, _ in order)
