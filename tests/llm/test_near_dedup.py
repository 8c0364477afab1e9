import random

import numpy as np
import pytest

from tidemark.llm import near_dedup as nd
from tidemark.llm.common import WORD, lowered
from tidemark.llm.components import components


def brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lowered(t or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), None if i is None else find(i), i is None or find(i) == i) for i, *_ in rows), key=str)


def corpus(seed, bases, copies, changes):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(changes)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(99)}"
            rows.append((rng.randrange(10 ** 9) * 100 + n, " ".join(words)))
            n += 1
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_against_brute_force(make_docs, odd_rows, width, percent):
    rows = odd_rows + corpus(1, 12, 12, 9) + [(k, "Exact copy of one text that is short") for k in range(50, 90)]
    got = nd.near_duplicates(make_docs(rows), width=width, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width, percent)


def test_clusters_in_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 8_000)
    rows = corpus(5, 2, 60, 7)
    got = nd.near_duplicates(make_docs(rows), width=3, percent=85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 85)


@pytest.mark.parametrize("shift", [3, 5])
def test_chains_over_blocks(make_docs, monkeypatch, shift):
    """Overlapping windows of a long text: at a shift of 3 words each is linked
    with the next and few others, at 5 just not (53 of 63 shingles)."""
    monkeypatch.setattr(nd, "BLOCK_BYTES", 3_000)
    words = [f"w{k}" for k in range(1000)]
    rows = [((7 * k) % 40, " ".join(words[shift * k:shift * k + 60])) for k in range(40)]
    got = nd.near_duplicates(make_docs(rows), width=3, percent=85).collect()
    want = brute(rows, 3, 85)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for _, _, c, _ in want}) == (1 if shift == 3 else 40)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.85, 0.95):
        both = rng.integers(0, 2 ** 63, 2000, np.uint64)
        k = int(2000 * (1 - share) / (1 + share))
        a = np.concatenate([both, rng.integers(0, 2 ** 63, 2 * k, np.uint64)])
        b = np.concatenate([both, rng.integers(0, 2 ** 63, k // 2, np.uint64)])
        true = 2000 / (2000 + 2 * k + k // 2)
        ra, rb = nd.registers(a), nd.registers(b)
        assert (nd.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()
        got = nd.estimate(ra, len(a), rb[None, :], np.array([len(b)]))[0]
        assert abs(got - true) < 4 * (true * (1 - true) / nd.REGISTERS) ** 0.5 + 0.01
        for j in (0.1, got - 0.02, got + 0.02):
            assert nd.estimated_at_least(ra, len(a), rb[None, :], np.array([len(b)]), j)[0] == (got >= j)


def test_empty_table(make_docs):
    assert nd.near_duplicates(make_docs([])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(60)] + [(200, x) for x in range(201, 260)] + [(300, 300), (None, 4), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 200 for k in range(200, 260)}}
