"""Quality checks and validation (QLT-01..08).

Every check of a table runs in one aggregation pass and returns a long-form
result (one row per rule), so results of many marts union into one report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import as_date

c = F.col


def _long(wide: DataFrame, names: list[str], value_alias: str) -> DataFrame:
    body = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {body}) AS (rule, {value_alias})")


def assertions(df: DataFrame, table: str, min_rows: int = 1, not_null: list[str] = (),
               invariants: dict[str, Column] | None = None) -> DataFrame:
    """QLT-01/02: row count ≥ ``min_rows``, no NULL in key columns, business
    invariants hold. (table_name, rule, violations, passed)."""
    invariants = invariants or {}
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count_if(c(k).isNull()).alias(f"not_null:{k}") for k in not_null]
    aggs += [F.count_if(~F.coalesce(p, F.lit(False))).alias(f"invariant:{n}") for n, p in invariants.items()]
    wide = df.agg(*aggs).withColumn(f"min_rows:{min_rows}",
                                    F.greatest(F.lit(min_rows) - c("row_count"), F.lit(0)).cast("long"))
    names = [f"min_rows:{min_rows}"] + [f"not_null:{k}" for k in not_null] + \
            [f"invariant:{n}" for n in invariants]
    out = _long(wide, names, "violations")
    return out.select(F.lit(table).alias("table_name"), "rule", "violations",
                      (c("violations") == 0).alias("passed"))


def freshness(feeds: dict[str, tuple[DataFrame, str]], as_of, max_lag_days: int = 2) -> DataFrame:
    """QLT-03: latest day per feed and its lag behind ``as_of``.
    (feed, latest_date, lag_days, stale)."""
    parts = []
    for name, (df, col) in feeds.items():
        latest = df.agg(F.max(c(col)).cast("date").alias("latest_date"))
        parts.append(latest.select(F.lit(name).alias("feed"), "latest_date",
                                   F.datediff(as_date(as_of), c("latest_date")).alias("lag_days")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("stale", F.coalesce(c("lag_days") > max_lag_days, F.lit(True)))


def validation_rules(df: DataFrame, rules: list[tuple[str, Column, float | None, float | None]],
                     table: str = "") -> DataFrame:
    """QLT-04: each rule is (name, aggregate, lo, hi) — build the aggregate
    with ``rule_agg`` to restrict it to a period or segment. All rules run in
    one pass. (table_name, rule, value, lo, hi, passed)."""
    wide = df.agg(*[agg.cast("double").alias(name) for name, agg, _, _ in rules])
    out = _long(wide, [r[0] for r in rules], "value")
    bounds = F.create_map(*[x for n, _, lo, hi in rules
                            for x in (F.lit(n), F.array(F.lit(lo).cast("double"), F.lit(hi).cast("double")))])
    lo, hi = bounds[c("rule")][0], bounds[c("rule")][1]
    return out.select(F.lit(table).alias("table_name"), "rule", "value", lo.alias("lo"), hi.alias("hi"),
                      (c("value").isNotNull() & (lo.isNull() | (c("value") >= lo))
                       & (hi.isNull() | (c("value") <= hi))).alias("passed"))


def rule_agg(func: str, col: str | Column, where: Column | None = None) -> Column:
    """Aggregate for ``validation_rules``: sum | count | avg | min | max | count_distinct,
    restricted to rows matching ``where``."""
    x = c(col) if isinstance(col, str) else col
    if where is not None:
        x = F.when(where, x)
    if func == "count":
        return F.count(x)
    return getattr(F, func)(x)


def contract_check(df: DataFrame, schema: T.StructType) -> list[tuple[str, str, str, str]]:
    """QLT-05: columns and types vs a declared contract (metadata only).
    Returns (column, expected, actual, status) with status ok / missing /
    extra / type_changed; any non-ok status is a breaking change → ``_v2``."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    expected = {f.name: f.dataType.simpleString() for f in schema.fields}
    out = []
    for n, t in expected.items():
        a = actual.get(n)
        out.append((n, t, a or "", "ok" if a == t else ("missing" if a is None else "type_changed")))
    out += [(n, "", t, "extra") for n, t in actual.items() if n not in expected]
    return out


def snapshot_diff(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """QLT-06: row counts of both snapshots and rows only in one of them
    (duplicates respected). (measure, rows). Each snapshot is read once: equal
    rows of both meet in one group, which holds how often each has them."""
    both = (prev.withColumns({"_p": F.lit(1), "_c": F.lit(0)})
            .unionByName(curr.withColumns({"_p": F.lit(0), "_c": F.lit(1)})))
    rows = both.groupBy(*prev.columns).agg(F.sum("_p").alias("_p"), F.sum("_c").alias("_c"))
    wide = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for n, x in (
        ("previous_rows", c("_p")), ("current_rows", c("_c")),
        ("added_rows", F.greatest(c("_c") - c("_p"), F.lit(0))),
        ("removed_rows", F.greatest(c("_p") - c("_c"), F.lit(0))))])
    return _long(wide, wide.columns, "rows").withColumnRenamed("rule", "measure")


def zero_row_diagnosis(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """QLT-07: rows surviving after each cumulative predicate, one pass.
    (step, predicate, surviving_rows) — the first step at 0 is the culprit."""
    aggs, acc = [F.count(F.lit(1)).alias("0:all rows")], None
    names = ["0:all rows"]
    for i, (name, pred) in enumerate(steps, 1):
        acc = pred if acc is None else acc & pred
        key = f"{i}:{name}"
        aggs.append(F.count_if(F.coalesce(acc, F.lit(False))).alias(key))
        names.append(key)
    wide = df.agg(*aggs)
    body = ", ".join(f"{i}, '{n.split(':', 1)[1]}', `{n}`" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {body}) AS (step, predicate, surviving_rows)")


def isolation_counts(df: DataFrame, key: str, date_col: str, start, end, measure: str,
                     quantiles: tuple[float, ...] = ()) -> DataFrame:
    """QLT-08: for one period — rows, distinct keys, and the measure's range,
    mean and (optional, approximate with bounded memory) quantiles."""
    d = c(date_col)
    p = df.filter((d >= as_date(start)) & (d < F.date_add(as_date(end), 1)))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"),
            F.min(measure).alias("min_value"), F.max(measure).alias("max_value"),
            F.round(F.avg(measure), 4).alias("avg_value")]
    aggs += [F.percentile_approx(measure, q, 10000).alias(f"p{int(q * 100)}") for q in quantiles]
    return p.agg(*aggs)
