import os
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import quality_rules as q
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def brute_repeat(words, w=3):
    grams = [tuple(words[k:k + w]) for k in range(len(words) - w + 1)]
    c = Counter(grams)
    return len({k + o for k, g in enumerate(grams) if c[g] > 1 for o in range(w)})


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b", "", "x y z " * 9, "a b c d a b c e f g d a b c"])
def test_repeated_windows(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert q.repeated_in_windows(words) == brute_repeat(words)


def test_verdict_does_not_depend_on_order(make_docs, odd_rows):
    rows = odd_rows + [(k, ("fine words of prose " * 3 + f"end {k} ") * (k % 9)) for k in range(20, 60)] + [
        (70, "## $$ %% " * 40), (71, "one\n" * 90)]
    docs = make_docs(rows)
    a = {(r.doc_id, r.n_words): r.kept for r in q.cascade(docs, statistics=["n_words"]).collect()}
    b = {(r.doc_id, r.n_words): r.kept for r in q.cascade(docs, q.RULES[::-1], statistics=["n_words"], sample_rows=3).collect()}
    assert a == b and len(a) == len({(i, t) for i, t, *_ in rows}) and True not in (a[70, 120], a[71, 90])


def test_order_is_by_rejection_per_cost(make_docs):
    rules = (q.Rule("never", ("n_words",), lambda n: False), q.Rule("always", ("n_words",), lambda n: True))
    docs = make_docs([(k, f"text {k}") for k in range(50)])
    assert [r.name for r in q.plan_cascade(docs, rules)] == ["always", "never"]
    assert q.plan_cascade(make_docs([]), rules) == list(rules)


def test_stops_at_the_first_rejection():
    m = q.Measured("a b")
    assert q.RULES[0].rejects(*(m[n] for n in q.RULES[0].uses)) and set(m._known) == {"n_words"}


def test_odd_rows_as_sql(spark, make_docs, odd_rows, scratch):
    rows = [r for r in odd_rows if r[0] not in (None, 5)]
    make_docs(rows).select("doc_id", "text").write.parquet(f"{scratch}/documents.parquet")
    got = QUERIES["op3_quality_rules"](spark, scratch).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{scratch}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op3_quality_rules"]).df().sort_values("doc_id")
    assert got[sorted(got)].values.tolist() == want[sorted(want)].values.tolist()
    assert os.path.isdir(scratch)


def test_empty_table(make_docs):
    assert q.cascade(make_docs([])).collect() == []
