import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import subword_lm as lm
from tidemark.llm.common import WORD, lowered


@pytest.fixture(scope="module")
def vocabulary():
    return lm.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def brute(vocabulary, logs, word):
    """(log probability, expected piece counts) over all segmentations."""
    number, s = {p: i for i, p in enumerate(vocabulary.pieces)}, lm.START + word
    arcs = []
    for a in range(len(s)):
        for b in range(a + 1, min(len(s), a + 16) + 1):
            if (i := number.get(s[a:b])) is not None:
                arcs.append((a, b, logs[i], [i]))
        if s[a] not in number:
            own = [number[lm.BYTE.format(x)] for x in s[a].encode()]
            arcs.append((a, a + 1, sum(logs[own]), own))

    def total(lo, hi):
        at = [-np.inf] * (hi + 1)
        at[lo] = 0.0
        for a, b, c, _ in sorted(arcs):
            if lo <= a and b <= hi:
                at[b] = np.logaddexp(at[b], at[a] + c)
        return at[hi]

    whole, uses = total(0, len(s)), Counter()
    for a, b, c, own in arcs:
        for i in own:
            uses[i] += math.exp(total(0, a) + c + total(b, len(s)) - whole)
    return whole, uses


@pytest.mark.parametrize("cells", [1 << 15, 16])
def test_lattice(vocabulary, monkeypatch, cells):
    monkeypatch.setattr(lm, "CELLS", cells)
    lattice, words = lm.Lattice(vocabulary), ["the", "hello", "über", "日x", "a", "😀é", "zzzz", "thethe"]
    with np.errstate(all="ignore"):
        got, counts = lattice.log_probabilities(words), np.arange(1.0, 9.0)
        uses = lattice.expected(words, counts)
        want = np.zeros(len(vocabulary.logs))
        for w, g, n in zip(words, got, counts):
            whole, own = brute(vocabulary, vocabulary.logs, w)
            assert abs(whole - g) < 1e-9
            for i, x in own.items():
                want[i] += n * x
    assert np.allclose(uses, want, atol=1e-9)


def test_scores(make_docs, odd_rows, vocabulary):
    train = [(1, "the cat sat on The mat"), (2, "the dog sat"), (3, None), (4, "cat")]
    model = lm.fit(make_docs(train), vocabulary)
    counts = Counter(w for _, t in train for w in WORD.findall(lowered(t or "")))
    assert (model.texts, model.tokens, model.distinct) == (4, sum(counts.values()) + 4, len(counts) + 1)
    assert abs(np.exp(model.logs).sum() - 1) < 1e-9
    probe = odd_rows + [(50, "The cat flew"), (51, "xqz " * 30)]
    got = sorted(map(tuple, lm.score(make_docs(probe), model).collect()), key=str)
    lattice = lm.Lattice(vocabulary, model.logs)
    want = []
    for i, t, *_ in probe:
        words = WORD.findall(lowered(t or ""))
        base = sum(math.log10((c + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
                   for c in [*(counts[w] for w in words), 4])
        score = (sum(n * float(lattice.log_probabilities([w])[0]) for w, n in Counter(words).items())
                 + model.logs[-1]) / math.log(10)
        want.append((i, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, model.tokens, base, score))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_rare_words_take_the_join(make_docs, vocabulary, monkeypatch):
    docs = make_docs([(k, f"common common rare{k}") for k in range(30)])
    model = lm.fit(docs, vocabulary, rounds=1)
    whole = sorted(map(tuple, lm.score(docs, model).collect()))
    for words in (0, 1):
        monkeypatch.setattr(lm, "HEAD_WORDS", words)
        for a, b in zip(whole, sorted(map(tuple, lm.score(docs, model).collect())), strict=True):
            assert a == pytest.approx(b)


def test_fitting_raises_the_likelihood(make_docs, vocabulary):
    docs = make_docs([(k, "erlyth onshent thereblenth") for k in range(20)])
    scores = [sum(r.score for r in lm.score(docs, lm.fit(docs, vocabulary, rounds=k)).collect()) for k in (0, 1, 2)]
    assert scores[0] < scores[1] < scores[2] < 0


def test_empty_tables(make_docs, vocabulary):
    model = lm.fit(make_docs([]), vocabulary)
    assert lm.score(make_docs([]), model).collect() == []
    (row,) = lm.score(make_docs([(1, "some text")]), model).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score < 0
