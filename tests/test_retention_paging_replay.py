"""Retention by day, pages by key, and the replay of quarantined rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from places import SF001
from tidemark.operators import retention as RT
from tidemark.operators.kernels import window_retention
from tidemark.publish import paging as PG
from tidemark.publish.publish import dry_run
from tidemark.sources import staging as STG
from tidemark.sources.testmap import roles

DAY0 = dt.date(2024, 1, 1)


def test_every_day_as_counted(spark):
    rnd = random.Random(7)
    rows = [(k % 4, f"u{rnd.randrange(6)}", dt.datetime.combine(DAY0 + dt.timedelta(rnd.randrange(80)), dt.time(rnd.randrange(24))))
            for k in range(160)] + [(1, None, dt.datetime(2024, 1, 5)), (2, "u1", None), (9, "only", dt.datetime(2024, 1, 9))]
    spans = RT.retention_spans(spark.createDataFrame(rows, "k int, who string, ts timestamp_ntz"), "k", "who", "ts", 10).cache()
    got = {}
    for r in spans.collect():
        for n in range((r.to_day - r.from_day).days + 1):
            assert (r.k, r.from_day + dt.timedelta(n)) not in got
            got[r.k, r.from_day + dt.timedelta(n)] = (r.curr, r.prev)
    want = {}
    for k in {r[0] for r in rows}:
        for n in range(-5, 130):
            d = DAY0 + dt.timedelta(n)
            ago = [((d - ts.date()).days, who) for kk, who, ts in rows if kk == k and who and ts]
            figures = len({w for a, w in ago if 0 <= a <= 10}), len({w for a, w in ago if 10 <= a <= 20})
            if any(figures):
                want[k, d] = figures
    assert got == want
    on = {r.k: (r.curr, r.prev) for r in RT.retention_on(spans, DAY0 + dt.timedelta(40)).collect()}
    assert on == {k: v for (k, d), v in want.items() if d == DAY0 + dt.timedelta(40)}


def test_the_reference_day_is_the_marts(spark):
    usage = roles(spark, SF001).license_usage
    ref = usage.select(F.max("lastvalidateddate").cast("date")).first()[0]
    spans = RT.retention_spans(usage, "customerid", "assigneduser", "lastvalidateddate", 30)
    got = {tuple(r) for r in RT.retention_on(spans, ref).select("customerid", "curr", "prev").collect()}
    want = window_retention(usage, "customerid", "assigneduser", "lastvalidateddate", ref, 30)
    assert got == {(r.customerid, r.curr, r.prev) for r in want.collect()} and got
    assert "NestedLoop" not in dry_run(spans) and "Cartesian" not in dry_run(spans)


ORDER = [("a", "asc"), ("b", "desc"), ("id", "asc")]


@pytest.fixture()
def mart(spark, scratch):
    rnd = random.Random(11)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y"]), k, k % 50 == 0) for k in range(1_000)]
    df = spark.createDataFrame(rows, "a int, b string, id int, rare boolean").repartition(5)
    PG.write_sorted(df, f"{scratch}/m", ORDER, rows_per_file=60)
    high = lambda v, way: (v is None, v) if way == "asc" else (v is not None, [-ord(x) for x in v or ""])
    return f"{scratch}/m", sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, high(r[1], "desc"), r[2]))


def test_pages_follow_each_other(spark, mart):
    path, rows = mart
    got, key = [], None
    while page := PG.page_after(spark, path, ORDER, 130, key):
        assert len(page) == min(130, len(rows) - len(got))
        got += [tuple(r) for r in page]
        key = PG.key_of(page[-1], ORDER)
    assert got == rows
    rare = [r for r in rows if r[3]]
    first = PG.page_after(spark, path, ORDER, 7, None, F.col("rare"))
    second = PG.page_after(spark, path, ORDER, 7, PG.key_of(first[-1], ORDER), F.col("rare"))
    assert [tuple(r) for r in first + second] == rare[:14]


def test_a_page_reads_a_bounded_number_of_files(spark, mart, monkeypatch):
    """Late pages read no more files than early ones."""
    path, rows = mart
    read = []
    plain = type(spark.read).parquet

    def counted(self, *paths, **kw):
        if len(paths) > 1 or "part-" in paths[0]:
            read.append(len(paths))
        return plain(self, *paths, **kw)

    monkeypatch.setattr(type(spark.read), "parquet", counted)
    for at in (0, 300, 800):
        read.clear()
        page = PG.page_after(spark, path, ORDER, 50, rows[at][:3])
        assert [tuple(r) for r in page] == rows[at + 1:at + 51] and sum(read) <= 3
    assert len(PG.files_after(spark, path, ORDER)) >= 17


def test_all_pages_at_once(spark, mart):
    """From the first page or from a key on."""
    path, rows = mart
    for at in (None, 0, 59, 130, 777, 999):
        want = rows if at is None else rows[at + 1:]
        got = PG.pages_after(spark, path, ORDER, 130, None if at is None else rows[at][:3]).collect()
        got = sorted((tuple(r) for r in got), key=lambda r: r[:2])
        assert got == [(k // 130, k % 130, *r) for k, r in enumerate(want)]


def test_pages_keep_equal_rows(spark, scratch):
    PG.write_sorted(spark.range(40).selectExpr("id % 4 AS a", "'x' AS b", "cast(id % 4 AS int) AS id"), f"{scratch}/t", ORDER,
                    rows_per_file=3)
    got = PG.pages_after(spark, f"{scratch}/t", ORDER, 7).collect()
    assert sorted((r.page, r.place) for r in got) == [(k // 7, k % 7) for k in range(40)]
    assert [r.a for r in sorted(got, key=lambda r: r[:2])] == sorted(k % 4 for k in range(40))


def test_the_paging_query_runs_as_many_jobs_for_many_pages_as_for_few(spark, monkeypatch):
    from tidemark.registry import QUERIES, incremental
    sc, jobs = spark.sparkContext, []
    for size in (400, 3):
        monkeypatch.setattr(incremental, "_PAGE", size)
        sc.setJobGroup(f"pages-{size}", "pages")
        try:
            rows = QUERIES["keyset_pages"](spark, SF001).collect()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"pages-{size}")))
        assert sorted(r[:2] for r in rows) == [(k // size, k % size) for k in range(len(rows))]
    assert len(rows) > 9 and jobs[0] == jobs[1]


RAW = "k string, t string, n string"


def test_replay_keeps_what_can_be_read_now(spark, scratch):
    rows = [("a", "2024-05-01", "1"), ("b", "05/31/2024", "2"), ("c", "junk", "3"), ("d", " ", "x"), ("e", None, None),
            (None, "2024-05-02", "5")]
    raw = spark.createDataFrame(rows, RAW)
    rules = {"no_key": F.col("k").isNull()}

    def state(df):
        return sorted((r.status, r.batch, str(r.k), r.drop_reason) for r in df.collect())

    first = STG.stage_batch(raw, scratch, "0", {"t": "iso_date", "n": "long"}, rules)
    assert state(first) == [("kept", "0", "a", None), ("kept", "0", "e", None), ("rejected", "0", "None", "no_key"),
                            ("rejected", "0", "b", "unreadable:t"), ("rejected", "0", "c", "unreadable:t"),
                            ("rejected", "0", "d", "unreadable:n")]
    assert STG.staged(first).columns == ["k", "t", "n"]
    for _ in range(2):  # once more changes nothing
        again = STG.replay(spark, scratch, raw.schema, "1", {"t": "date", "n": "long"}, rules)
        assert state(again) == [("kept", "0", "a", None), ("kept", "0", "e", None), ("kept", "1", "b", None),
                                ("rejected", "1", "None", "no_key"), ("rejected", "1", "c", "unreadable:t"),
                                ("rejected", "1", "d", "unreadable:n")]
    b = STG.staged(again).filter("k = 'b'").first()
    assert (str(b.t), b.n) == ("2024-05-31", 2)


def test_a_batch_is_written_in_one_pass(spark, scratch):
    """Kept and rejected rows come from one evaluation of the input."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.createDataFrame([("a", "2024-05-01", "1"), ("b", "junk", "2")], RAW).mapInArrow(touch, RAW)
    out = STG.stage(raw, types={"t": "date"}, junk={"no_key": F.col("k").isNull()}, dropped_to=f"{scratch}/s")
    assert [r.k for r in out.collect()] == ["a"] and seen.value == 2
