"""Lineage read from plans."""

import pytest
from pyspark.sql import functions as F

from places import SMOKE
from tidemark.plans import refresh as R
from tidemark.plans.telemetry import telemetry_profiles
from tidemark.publish import lineage as L
from tidemark.publish.versions import latest
from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, roles


def test_columns_rows_and_subqueries(spark):
    a = L.tagged("a", spark.createDataFrame([(1, 2, "x")], "k int, v int, unused string"))
    b = L.tagged("b", spark.createDataFrame([(1, 5, 6)], "k int, w int, flag int"))
    top = b.select(F.max("w")).scalar()
    out = (a.join(b.filter("flag > 0"), a["k"] == b["k"], "left").groupBy(a["k"].alias("key"))
           .agg(F.sum(F.col("v") + F.col("w")).alias("s"), F.lit(1).alias("one")).filter(F.col("s") < top)
           .unionByName(a.select(F.col("v").alias("key"), F.lit(0).cast("long").alias("s"), F.lit(2).alias("one"))))
    got = L.read(out)
    assert got.sources == {"a", "b"}
    assert got.columns == {"key": {("a", "k"), ("a", "v")}, "s": {("a", "v"), ("b", "w")}, "one": set(),
                           "*": {("a", "k"), ("b", "k"), ("b", "flag"), ("b", "w"), ("a", "v")}}


def test_semi_joins_windows_explodes(spark):
    from pyspark.sql import Window
    a = L.tagged("a", spark.createDataFrame([(1, [1], "x")], "k int, xs array<int>, d string"))
    b = L.tagged("b", spark.createDataFrame([(1, 2)], "k int, w int"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("d"))
    got = L.read(a.join(b, "k", "left_semi").select("k", F.explode("xs").alias("x"), rank.alias("r")))
    assert got.columns["x"] == {("a", "xs")} and got.columns["r"] == {("a", "k"), ("a", "d")}
    assert got.columns["*"] == {("a", "k"), ("b", "k")}


def test_a_tag_hides_what_lies_below(spark):
    a = L.tagged("a", spark.range(3))
    got = L.read(L.tagged("m", a.filter("id > 1").select((F.col("id") + 1).alias("n"))).select("n"))
    assert got.sources == {"m"} and got.columns == {"n": {("m", "n")}, "*": set()}
    inner = {"m": L.Lineage({"a"}, {"n": {("a", "id")}, "*": {("a", "id")}})}
    assert got.through(inner) == L.Lineage({"a"}, {"n": {("a", "id")}, "*": {("a", "id")}})


@pytest.mark.parametrize("shared", [False, True])
def test_declared_dependencies_are_those_of_the_plans(spark, shared):
    src = roles(spark, SMOKE).tagged()
    prof = telemetry_profiles(src)
    inner = {f"profile_{n}": L.read(getattr(prof, n)) for n in R.PROFILED}
    tel = prof.tagged() if shared else None
    found = {m: L.read(build(src)).through(inner)
             for m, build in R.default_builders(ORDERS_AS_OF, EVENTS_AS_OF, tel=tel).items()}
    assert L.differences(found, R.DEPENDS_ON) == []
    wrong = {**R.DEPENDS_ON, "S6": ["rc_events", "account"], "S7": ["rc_events"]}
    assert L.differences(found, wrong) == ["S6 declares account, unread", "S7 reads il_events, undeclared"]


def test_a_refresh_with_a_wrong_declaration_is_not_announced(spark, scratch, monkeypatch):
    src = roles(spark, SMOKE)
    monkeypatch.setitem(R.DEPENDS_ON, "S6", ["rc_events", "login"])
    with pytest.raises(ValueError, match="S6 declares login, unread"):
        R.run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="r")
    assert latest(spark, scratch) is None
    columns = spark.read.parquet(f"{scratch}/run_id=r/_lineage_columns")
    got = {tuple(r) for r in columns.filter("mart = 'S6' AND column_name = 'schedule_page_visits'").collect()}
    assert got == {("S6", "schedule_page_visits", "rc_events", "tracked_event_name")}
    assert columns.filter("mart = 'MASTER' AND source = 'S14'").count() > 0
