"""Identity clusters and the change feed against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes as CH, identity as ID
from tidemark.publish.publish import dry_run


def brute_clusters(links):
    of = {}
    for a, k in links:
        if a is not None and k is not None:
            of.setdefault(a, set()).add(k)
    label = {a: a for a in of}
    while True:
        low = {}
        for a, ks in of.items():
            for k in ks:
                low[k] = min(low.get(k, label[a]), label[a])
        new = {a: min(low[k] for k in ks) for a, ks in of.items()}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("hot_rows", [5, 100_000])
def test_clusters_as_plain_search(spark, hot_rows):
    """Random links, a long chain, and an id that a third of all accounts share."""
    rnd = random.Random(3)
    links = [(f"a{rnd.randrange(200):03}", f"k{rnd.randrange(260)}") for _ in range(220)]
    links += [(f"c{k:03}", f"x{k}") for k in range(60)] + [(f"c{k + 1:03}", f"x{k}") for k in range(60)]
    links += [(f"h{k:03}", "shared") for k in range(150)] + [(None, "shared"), ("z", None), links[0]]
    got = ID.clusters(spark.createDataFrame(links, "a string, k string"), "a", "k", hot_rows)
    assert {r.a: r.cluster for r in got.collect()} == brute_clusters(links)


def test_no_links(spark):
    assert ID.clusters(spark.createDataFrame([], "a string, k string"), "a", "k").count() == 0


def test_hot_keys_meet_a_broadcast(spark):
    rows = spark.createDataFrame([("h",)] * 20 + [("x",), ("y",)], "k string")
    table = spark.createDataFrame([("h", 1), ("x", 2), ("q", 3)], "k string, v int")
    got = ID.lookup(rows, "k", table, 10)
    assert sorted((r.k, r.v) for r in got.collect()) == [("h", 1)] * 20 + [("x", 2)]


def brute_changes(a, b, keys):
    """Rows as dicts; rows of one key are paired in the order of their values."""
    def by_key(rows):
        out = {}
        for r in sorted(rows, key=lambda r: [(v is not None, v) for v in r.values()]):
            out.setdefault(tuple(r[k] for k in keys), []).append(r)
        return {(*k, n): r for k, rs in out.items() for n, r in enumerate(rs)}

    x, y, out = by_key(a), by_key(b), []
    for k in x.keys() | y.keys():
        if k not in x or k not in y:
            out.append((k[:-1], "added" if k not in x else "removed", ()))
        elif x[k] != y[k]:
            out.append((k[:-1], "changed", tuple(n for n in x[k] if x[k][n] != y[k][n])))
    return sorted(out, key=str)


def test_changes_as_plain_comparison(spark, scratch):
    rnd = random.Random(5)
    schema = "k string, j int, v int, w string"
    a = [(f"k{n}", n % 3 or None, rnd.randrange(3) or None, rnd.choice(["x", "y", None])) for n in range(300)]
    b = [r if rnd.random() < 0.8 else (r[0], r[1], rnd.randrange(3) or None, "z") for r in a[20:]]
    b += [("new", None, 1, "q"), (None, None, None, None), ("k50", 2, 9, "twin")]
    for name, rows in (("a", a), ("b", b)):
        CH.write_run(spark.createDataFrame(rows, schema), f"{scratch}/{name}", ["k", "j"])
    got = [((r.k, r.j), r.change, tuple(r.changed_columns))
           for r in CH.changes(spark, f"{scratch}/a", f"{scratch}/b", ["k", "j"]).collect()]
    names = ["k", "j", "v", "w"]
    assert sorted(got, key=str) == brute_changes([dict(zip(names, r)) for r in a], [dict(zip(names, r)) for r in b], ["k", "j"])
    assert CH.changes(spark, f"{scratch}/a", f"{scratch}/a", ["k", "j"]).count() == 0


def test_equal_buckets_are_not_read(spark, scratch):
    rows = spark.range(2_000).withColumn("v", F.col("id") % 7)
    CH.write_run(rows, f"{scratch}/a", ["id"])
    CH.write_run(rows.withColumn("v", F.when(F.col("id") == 17, 99).otherwise(F.col("v"))), f"{scratch}/b", ["id"])
    buckets = CH.unequal_buckets(spark, f"{scratch}/a", f"{scratch}/b")
    assert len(buckets) == 1
    feed = CH.changes(spark, f"{scratch}/a", f"{scratch}/b", ["id"])
    assert [(r.id, r.change, r.changed_columns) for r in feed.collect()] == [(17, "changed", ["v"])]
    scans = [ln for ln in dry_run(feed).splitlines() if "PartitionFilters" in ln]
    assert len(scans) == 2 and all(f"_bucket#" in ln and f"= {buckets[0]})" in ln or f"IN ({buckets[0]})" in ln for ln in scans)


def test_a_column_more_counts_where_it_holds_a_value(spark, scratch):
    CH.write_run(spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), f"{scratch}/a", ["k"])
    CH.write_run(spark.createDataFrame([(1, 5, 1), (2, 6, None)], "k int, v int, n int"), f"{scratch}/b", ["k"])
    got = CH.changes(spark, f"{scratch}/a", f"{scratch}/b", ["k"]).collect()
    assert [(r.k, r.changed_columns) for r in got] == [(1, ["n"])]
