"""Property tests: kernels vs brute force on random small inputs (NULL keys,
NULL names, NULL sessions, repeated rows, hot keys)."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.kernels import count_if, distinct, ever, first, last, milestones, running_by_day

D0 = dt.date(2024, 1, 1)
ACCTS = st.sampled_from(["a", "b", "hot", None])
NAMES = st.sampled_from(["x", "y", "z", None])
SESS = st.sampled_from(["s1", "s2", "s3", None])
DAYS = st.one_of(st.none(), st.integers(0, 20).map(lambda n: D0 + dt.timedelta(days=n)))
EVENTS = st.lists(st.tuples(ACCTS, NAMES, SESS, DAYS), min_size=1, max_size=40)
SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _brute(rows):
    df = pd.DataFrame(rows, columns=["k", "name", "s", "d"])
    out = {}
    for k, g in df.groupby("k", dropna=False):
        k = None if (isinstance(k, float) and pd.isna(k)) else k
        x = g[g.name == "x"]
        dates_x = [d for d in x.d if d is not None]
        dates_all = [d for d in g.d if d is not None]
        out[k] = (
            int(len(x) > 0),
            min(dates_x) if dates_x else None,
            max(dates_all) if dates_all else None,
            len(x),
            g.s.dropna().nunique(),
            x.s.dropna().nunique(),
        )
    return out


@SETTINGS
@given(EVENTS)
def test_milestones_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, name string, s string, d date")
    is_x = F.col("name") == "x"
    m = milestones(df, "k", {"ever_x": ever(is_x), "first_x": first(is_x, F.col("d")),
                             "last_any": last(None, F.col("d")), "n_x": count_if(is_x),
                             "sessions": distinct(), "sessions_x": distinct(is_x)}, distinct_col="s")
    got = {r.k: (r.ever_x, r.first_x, r.last_any, r.n_x, r.sessions, r.sessions_x) for r in m.collect()}
    assert got == _brute(rows)


FACTS = st.lists(st.tuples(st.sampled_from(["a", "hot"]), st.integers(0, 15), st.integers(1, 5)),
                 min_size=0, max_size=30)
PROBES = st.lists(st.tuples(st.sampled_from(["a", "hot", "c"]), st.integers(0, 15)), min_size=1, max_size=10)


@SETTINGS
@given(FACTS, PROBES)
def test_running_by_day_matches_brute_force(spark, facts, probes):
    f = spark.createDataFrame([(k, D0 + dt.timedelta(days=d), n) for k, d, n in facts] or [("zz", D0, 0)],
                              "k string, day date, n long")
    f = f.groupBy("k", "day").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    p = spark.createDataFrame([(k, D0 + dt.timedelta(days=d)) for k, d in probes], "k string, day date")
    got = {(r.k, r.day): (r.n, r.top) for r in running_by_day(f, p, "k", "day", ["n"], ["top"]).collect()}
    want = {}
    for k, d in set(probes):
        upto = [n for fk, fd, n in facts if fk == k and fd <= d]
        want[(k, D0 + dt.timedelta(days=d))] = (sum(upto), max(upto) if upto else None)
    assert got == want


USERS = st.sampled_from(["u1", "u2", "u3", None])
KEYS = st.lists(st.tuples(st.sampled_from(["a", "hot"]), USERS, st.one_of(st.none(), st.integers(0, 60))),
                min_size=1, max_size=30)


@SETTINGS
@given(KEYS)
def test_dormancy_matches_brute_force(spark, rows):
    from tidemark.operators.kernels import dormancy
    as_of = D0 + dt.timedelta(days=60)
    data = [(k, u, None if d is None else D0 + dt.timedelta(days=d)) for k, u, d in rows]
    df = spark.createDataFrame(data, "k string, u string, lv date")
    got = {r.k: (r.total, r.dormant) for r in dormancy(df, "k", "u", "lv", as_of, 30).collect()}
    want = {}
    for k in {r[0] for r in data}:
        users = {u for kk, u, _ in data if kk == k and u is not None}
        dormant = {u for kk, u, lv in data if kk == k and u is not None
                   and (lv is None or lv < as_of - dt.timedelta(days=30))}
        want[k] = (len(users), len(dormant))
    assert got == want


USAGE = st.lists(st.tuples(st.sampled_from(["c1", "hot"]), USERS, st.integers(0, 70), st.sampled_from([0, 9])),
                 min_size=1, max_size=30)


@SETTINGS
@given(USAGE, st.booleans())
def test_window_retention_matches_brute_force(spark, rows, exclusive):
    from tidemark.operators.kernels import window_retention
    ref = D0 + dt.timedelta(days=70)
    data = [(k, u, dt.datetime.combine(ref - dt.timedelta(days=d), dt.time(h))) for k, u, d, h in rows]
    df = spark.createDataFrame(data, "k string, u string, t timestamp_ntz")
    got = {r.k: (r.curr, r.prev) for r in window_retention(df, "k", "u", "t", ref, 30, exclusive).collect()}
    lo = dt.datetime.combine(ref - dt.timedelta(days=60), dt.time())
    hi = dt.datetime.combine(ref - dt.timedelta(days=30), dt.time())
    want = {}
    for k in {r[0] for r in data if r[2] >= lo}:
        mine = [(u, t) for kk, u, t in data if kk == k and u is not None]
        curr = {u for u, t in mine if t >= hi}
        prev = {u for u, t in mine if lo <= t < hi} if exclusive else {u for u, t in mine if lo <= t <= hi}
        want[k] = (len(curr), len(prev))
    assert got == want


BASE = st.lists(st.sampled_from(["a", "b", "hot", None]), min_size=1, max_size=8)
EVT = st.lists(st.tuples(st.sampled_from(["a", "b", "hot", None]), st.sampled_from(["x", "y", None])),
               max_size=20)


@SETTINGS
@given(BASE, EVT)
def test_never_did_matches_brute_force(spark, base, events):
    from tidemark.operators.kernels import never_did
    b = spark.createDataFrame([(i, k) for i, k in enumerate(base)], "row long, k string")
    e = spark.createDataFrame(events or [(None, None)], "account_id string, tracked_event_name string")
    got = sorted(r.row for r in never_did(b, "k", e, "account_id", F.col("tracked_event_name") == "x").collect())
    did = {k for k, n in events if k is not None and n == "x"}
    want = sorted(i for i, k in enumerate(base) if k is None or k not in did)
    assert got == want


CONTRACTS = st.lists(st.tuples(st.sampled_from(["A", "B", "hot"]), st.one_of(st.none(), st.integers(0, 5))),
                     min_size=1, max_size=15)


@SETTINGS
@given(CONTRACTS)
def test_latest_contract_matches_brute_force(spark, rows):
    from fixtures import sources
    from tidemark.plans.master import latest_contract
    data = [{"contract_id": i, "account_id": a, "status": "Activated", "_fivetran_deleted": False,
             "customer_signed_date": None if d is None else D0 + dt.timedelta(days=d)} for i, (a, d) in enumerate(rows)]
    got = {r.account_id: r.contract_id for r in latest_contract(sources(spark, contract=data)).collect()}
    want = {}
    for a in {r["account_id"] for r in data}:
        mine = [r for r in data if r["account_id"] == a]
        # NULL date sorts first (high), then latest date, then highest contract id
        best = max(mine, key=lambda r: (r["customer_signed_date"] is None,
                                        r["customer_signed_date"] or dt.date.min, r["contract_id"]))
        want[a] = best["contract_id"]
    assert got == want
