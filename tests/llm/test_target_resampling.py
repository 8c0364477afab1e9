"""Resampling against a plain version of every step."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import target_resampling as T
from tidemark.llm import textblocks
from tidemark.llm.queries import op13_target_resampling

SF = "/root/testdata/sf0.01"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def bag(text):
    ws = words(text)
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))])


def brute(docs, target, percent=25, least=20):
    bags = [bag(t) for _, t in docs]
    s, t = Counter(), Counter()
    for b in bags:
        s.update(b)
    for text in target:
        t.update(bag(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0))))
            for b in s}
    out = []
    for (key, text), b in zip(docs, bags):
        n = sum(b.values())
        weight = sum(gain[k] * c for k, c in b.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
                    len(words(text))])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(eligible[:percent * len(eligible) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_query_as_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op13_target_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target)


def test_odd_rows(spark, make_docs, odd_rows):
    long = [(k, " ".join(f"w{k * j % 31}" for j in range(25))) for k in range(20, 60)]
    rows = [r[:2] for r in odd_rows] + long + [long[0]] * 5 + [(None, long[1][1])] * 3
    target = spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], "item_id long, text string")
    got = T.resample(make_docs(rows), target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ["w1 w2 w3", None])
    assert T.resample(make_docs([]).limit(0), target).collect() == []


def test_words_across_blocks(monkeypatch):
    text = " ".join(f"Wörd{k % 50}" for k in range(3_000))
    whole = T.features(text.encode())
    monkeypatch.setattr(textblocks.blocks, "__defaults__", (100,))
    monkeypatch.setattr(T, "HELD", 1_000)
    n, at, counts = T.features(text.encode())
    assert n == whole[0] == 3_000 and dict(zip(at.tolist(), counts.tolist())) == dict(bag(text))
    assert at.tolist() == whole[1].tolist() and counts.tolist() == whole[2].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-40_000, 40_000), min_size=70, max_size=70),
       st.lists(st.dictionaries(st.integers(0, 69), st.integers(1, 100_000), max_size=20), min_size=1, max_size=5))
def test_planes_sum_exactly(gain, rows):
    row_of = np.array([k for k, r in enumerate(rows) for _ in r], np.int64)
    at = np.array([b for r in rows for b in sorted(r)], np.int64)
    counts = np.array([r[b] for r in rows for b in sorted(r)], np.int64)
    got = T.weight_sums(row_of, at, counts, len(rows), 70, T.gain_planes(np.array(gain)))
    assert got.tolist() == [sum(gain[b] * c for b, c in r.items()) for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_hold_over_many_ranges(spark, make_docs, parts):
    """Ranks have no gap, whatever the number of ranges."""
    docs = make_docs([(k, " ".join(f"w{k * j % 97}" for j in range(30))) for k in range(400)], parts)
    target = spark.createDataFrame([(1, "w1 w2 w3 w4")], "item_id long, text string")
    got = [r for r in T.resample(docs, target).collect() if r["rank"] is not None]
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 101))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)
