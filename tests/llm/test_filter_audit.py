"""Filter audits against brute force over every order."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats_of(text):
    text, words = text or "", WORD.findall(text or "")
    return (len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text))


def brute(docs, labels):
    """docs: (doc_id, text, lang, source); labels: (doc_id, quality, toxic)."""
    fails = []
    for key, text, _, part in docs:
        w, d, up, n, sp = stats_of(text)
        copy = any(key is not None and k is not None and k < key and (t or "") == (text or "") for k, t, _, _ in docs)
        own = [x for x in labels if key is not None and x[0] == key]
        good, toxic = (any(x[j] == 1 for x in own) for j in (1, 2))
        failed = {f for f, bad in zip("ABCDE", (w < 50, 100 * d < 65 * w, 100 * up > 5 * n, sp > 0, copy)) if bad}
        fails.append((part or "", failed, good, toxic))
    out, removed_by = {}, {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                gone = [x for x in own if x not in left and f in x[1] and set(order[:step - 1]) & x[1]]
                out[part, order, step] = [len(left), len(here), len(gone), sum(x[1] == {f} for x in own),
                                          sum(x[2] for x in here), sum(x[3] for x in here)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(here)
    return {k: tuple(v) + (removed_by[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def audited(spark, docs, labels):
    failed = A.failures(A.statistics(docs), spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in A.audit(failed, "ABCDE").collect()}


@pytest.fixture()
def rows(odd_rows):
    clean = " ".join(f"word{k}" for k in range(60))
    return odd_rows + [(10, clean, "en", "a"), (11, clean, "en", "b"), (12, clean, "en", None), (12, clean, "en", None),
                       (None, clean, "en", "a"), (13, clean + " |", "en", "a"), (14, "a " * 60, "en", "a"),
                       (15, clean.upper(), "en", "b"), (16, "A B |", "en", "b"), (17, "a\rb\x0bc\x0cd", "en", "b")]


def test_as_brute_force(spark, make_docs, rows):
    labels = [(1, 1, 0), (5, 1, 1), (5, 0, None), (11, 1, 0), (12, 0, 1), (16, None, 1), (None, 1, 1), (99, 1, 1)]
    assert audited(spark, make_docs(rows), labels) == brute(rows, labels)


def test_statistics_and_dictionary(make_docs, rows):
    docs = make_docs(rows, 2)
    got = sorted(tuple(r[n] for n in A.STATISTICS) for r in A.statistics(docs, shard_docs=3).collect())
    assert got == sorted(stats_of(r[1]) for r in rows)
    assert sorted(tuple(r[n] for n in A.STATISTICS) for r in A.statistics(docs, shard_docs=3, bits=3).collect()) == got


@pytest.mark.parametrize("bits", [A.COLUMN_BITS, 2])
def test_columns_mean_one_word_everywhere(make_docs, bits):
    """A shard per document, one dictionary: equal words have equal columns,
    and different words different ones, even if their hashes are the same."""
    docs = make_docs([(1, "b a b"), (2, "c b"), (3, ""), (4, "é f g h i j k")], 1)
    rows = A.shards(docs, shard_docs=1)
    apart = A.colliding(rows, bits)
    assert bool(apart) == (bits == 2)
    column_of = {bytes(r.word): r.column for r in A.dictionary(rows, bits).collect()}
    assert len(column_of) == len(set(column_of.values())) == 10
    cells = {}
    numbers = F.transform("words", lambda w: A.column_of(w, apart, bits)).alias("columns")
    for r in rows.select("*", numbers).collect():
        words = [bytes(w) for w in r.words]
        assert r.columns == [column_of[w] for w in words]
        for k, key in enumerate(r.ids):
            cells[key] = {words[i]: n for i, n in list(zip(r.indices, r.counts))[r.indptr[k]:r.indptr[k + 1]]}
    assert cells[1] == {b"a": 1, b"b": 2} and cells[2] == {b"b": 1, b"c": 1} and cells[3] == {}


def test_empty_tables(spark, make_docs):
    assert audited(spark, make_docs([]).limit(0), []) == {}
    assert len(audited(spark, make_docs([(1, "x")]), [])) == 600


def test_a_word_of_every_document_is_one_per_shard(make_docs):
    rows = A.shards(make_docs([(k, f"the the x{k}") for k in range(300)], 3)).collect()
    assert [bytes(w) for r in rows for w in r.words].count(b"the") == len(rows) == 3
