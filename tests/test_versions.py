"""The version log: one winner, complete switches, pins and cleaning."""

import os
import threading

import pytest

from tidemark.publish import files, publish as PB, versions as VS


@pytest.fixture(params=["local", "hadoop"])
def store(request, spark, monkeypatch, scratch):
    """The same log through both ways to the store."""
    if request.param == "hadoop":
        monkeypatch.setattr(files, "_local", lambda spark, path: None)
    return scratch


def _write(spark, root, run, marts=("A", "B")):
    out = {}
    for m in marts:
        path = f"{root}/run_id={run}/{m}"
        spark.range(3).write.parquet(path)
        out[m] = (path, 3)
    return out


def test_small_files(spark, store):
    path = f"{store}/x/a.json"
    assert files.read(spark, path) is None and files.names(spark, f"{store}/x") == {}
    assert files.put_if_absent(spark, path, "ä1") and not files.put_if_absent(spark, path, "2")
    assert files.read(spark, path) == "ä1" and [n for n in files.names(spark, f"{store}/x") if n == "a.json"]
    files.delete(spark, f"{store}/x")
    files.delete(spark, f"{store}/x")
    assert files.read(spark, path) is None


def test_of_two_announcers_one_wins(spark, scratch):
    """Both start from the same version; whatever the order, one is refused."""
    PB.announce(spark, scratch, "r0", _write(spark, scratch, "r0"))
    for k in range(5):
        base, results = VS.latest(spark, scratch)["version"], {}
        written = {n: _write(spark, scratch, f"{k}{n}") for n in "xyz"}
        start = threading.Barrier(3)

        def run(name):
            start.wait()
            try:
                results[name] = PB.announce(spark, scratch, f"{k}{name}", written[name], based_on=base)["version"]
            except VS.ConcurrentRefresh:
                results[name] = None

        threads = [threading.Thread(target=run, args=(n,)) for n in "xyz"]
        [t.start() for t in threads]
        [t.join() for t in threads]
        winner = [n for n, v in results.items() if v is not None]
        assert len(winner) == 1 and results[winner[0]] == base + 1
        assert {PB.current_version(spark, scratch, m)["run_id"] for m in "AB"} == {f"{k}{winner[0]}"}


def test_announcements_without_a_base_all_count(spark, scratch):
    """Single marts go on top of each other: none is lost."""
    written = {f"M{k}": _write(spark, scratch, f"s{k}", [f"M{k}"]) for k in range(6)}
    threads = [threading.Thread(target=PB.announce, args=(spark, scratch, m, w)) for m, w in written.items()]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = VS.latest(spark, scratch)
    assert now["version"] == 5 and set(now["marts"]) == set(written)


def test_two_refreshes_at_once(spark, scratch):
    """A refresh that started before another was announced is refused, and the
    announced one stays whole."""
    from places import SMOKE
    from tidemark.functions import vocabulary as V
    from tidemark.plans import refresh as R
    from tidemark.sources.testmap import EVENTS_AS_OF, ORDERS_AS_OF, roles
    src = roles(spark, SMOKE)

    def other(mart, df):  # another refresh is announced while this one is at its gate
        if mart == "MASTER":
            R.run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="fast", gate=lambda m, d: [])
        return []

    with pytest.raises(VS.ConcurrentRefresh):
        R.run_all(spark, src, ORDERS_AS_OF, scratch, events_as_of=EVENTS_AS_OF, run_id="slow", gate=other)
    assert {PB.current_version(spark, scratch, t)["run_id"] for t in [*V.MART_TABLES.values(), V.MASTER_TABLE]} == {"fast"}


def test_a_pinned_run_survives_cleaning(spark, store):
    for r in ("r1", "r2", "r3", "r4"):
        PB.announce(spark, store, r, _write(spark, store, r))
    pinned = VS.pin(spark, store, "audit", version=0)
    with pytest.raises(FileExistsError):
        VS.pin(spark, store, "audit")
    _write(spark, store, "unfinished")
    gone = VS.clean(spark, store, keep=2)
    assert [g.rsplit("/", 1)[1] for g in gone] == ["run_id=r2"]
    assert PB.read_mart(spark, store, "A", order_by=[], version=pinned["version"]).count() == 3
    assert PB.read_mart(spark, store, "A", order_by=[]).count() == 3
    assert PB.versions(spark, store, "A").count() == 3 and VS.read_version(spark, store, 1) is None
    VS.unpin(spark, store, "audit")
    assert [g.rsplit("/", 1)[1] for g in VS.clean(spark, store, keep=2)] == ["run_id=r1"]
    assert "run_id=unfinished" in os.listdir(store)
    assert [g.rsplit("/", 1)[1] for g in VS.clean(spark, store, unannounced_hours=-1)] == ["run_id=unfinished"]
    with pytest.raises(FileNotFoundError):
        VS.pin(spark, store, "late", version=0)


def test_marts_of_an_old_run_stay_while_a_version_has_them(spark, scratch):
    PB.announce(spark, scratch, "r1", _write(spark, scratch, "r1"))
    PB.announce(spark, scratch, "r2", _write(spark, scratch, "r2", ["A"]))  # B stays that of r1
    PB.announce(spark, scratch, "r3", _write(spark, scratch, "r3", ["A"]))
    assert [g.rsplit("/", 2)[1:] for g in VS.clean(spark, scratch, keep=1)] == [["run_id=r1", "A"], [os.path.basename(scratch), "run_id=r2"]]
    assert PB.read_mart(spark, scratch, "B", order_by=[]).count() == 3


def test_a_pin_that_ran_out_holds_nothing(spark, scratch):
    for r in ("r1", "r2"):
        PB.announce(spark, scratch, r, _write(spark, scratch, r))
    VS.pin(spark, scratch, "old", version=0, hours=-1)
    assert len(VS.clean(spark, scratch, keep=1)) == 1 and VS.pinned(spark, scratch) == set()
