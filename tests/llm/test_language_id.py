import zlib
from collections import Counter

import numpy as np

from tidemark.llm import language_id as lid
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES

EN = "the quick brown fox jumps over the lazy dog and then it thinks about what this would mean for them "
DE = "der schnelle braune fuchs springt über den faulen hund und denkt dann nach was das für sie bedeutet "


def test_predicts(make_docs, odd_rows):
    rows = [(10, EN * 3, "en", None), (11, DE * 3, "de", None), (12, "12 34", "xx", None), (13, EN, None, None)]
    prototypes = lid.fit(make_docs(rows + odd_rows[:2]))
    assert list(prototypes) == ["de", "en"]
    docs = make_docs(odd_rows + [(20, "what would the dog think"), (21, "und was denkt der hund"), (22, "1 2 | ?")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in lid.predict(docs, prototypes).collect()]
    pred = {i: (p, s) for i, p, s in got}
    assert len(got) == len(odd_rows) + 3 and all(0 <= s <= 1 for _, _, s in got)
    assert pred[20][0] == "en" and pred[21][0] == "de"
    assert all(pred[i] == ("und", 0.0) for i in (1, 2, 3, 22))


def test_cosine_by_hand():
    v = lid.Vectors(64)
    codes, counts = lid.trigrams("Hello, hello!")
    assert counts.sum() == 2 * 5 + 1  # he, hel, ell, llo, lo and once more
    whole = v.texts([(codes, counts)])[0]
    letter = {c: np.random.default_rng([lid.SEED, ord(c)]).integers(0, 2, 64) * 2 - 1 for c in " helo"}
    text = " hello hello "
    want = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(text, text[1:], text[2:]))
    assert np.allclose(whole, want) and np.allclose(v.bundled(codes, counts), want)


def test_blocks_add_up(monkeypatch):
    text = "ab  c. DE?f " * 50 + "日本"
    whole = lid.trigrams(text)
    for size in (7, 64):
        monkeypatch.setattr(lid, "BLOCK", size)
        assert all((a == b).all() for a, b in zip(whole, lid.trigrams(text)))


def test_empty_tables(make_docs):
    assert lid.fit(make_docs([])) == {}
    assert lid.predict(make_docs([]), {}).collect() == []
    assert [tuple(r) for r in lid.predict(make_docs([(1, "text")]), {}).collect()] == [(1, "und", 0.0)]


def test_query_against_plain_cosines(spark):
    """Fit and prediction of the query, letter by letter, over all rows."""
    sf, letters, bound = "/root/testdata/sf0.001", {}, {}

    def letter(c):
        if c not in letters:
            letters[c] = np.random.default_rng([lid.SEED, ord(c)]).integers(0, 2, lid.DIMENSIONS) * 2 - 1
        return letters[c]

    def vector(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded, total = f" {' '.join(words)} ", np.zeros(lid.DIMENSIONS)
        for gram, n in Counter(zip(padded, padded[1:], padded[2:])).items() if words else ():
            if gram not in bound:
                bound[gram] = np.roll(letter(gram[0]), 2) * np.roll(letter(gram[1]), 1) * letter(gram[2])
            total += n * bound[gram]
        return total

    docs = {r.doc_id: (vector(r.text), r.lang) for r in table(spark, sf, "documents").collect()}
    sums = {}
    for i, (v, lang) in docs.items():
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None:
            sums[lang] = sums.get(lang, 0) + v
    got = QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        v = docs[r.doc_id][0]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
        assert abs(max(0.0, cosines[r.lang_pred]) - r.score) < 1e-4 and cosines[r.lang_pred] > max(cosines.values()) - 1e-4


def test_first_of_equal_languages(make_docs):
    v = lid.fit(make_docs([(1, EN, "en", None)]))["en"]
    got = lid.predict(make_docs([(1, EN)]), {"aa": v, "bb": v}).collect()
    assert [r.lang_pred for r in got] == ["aa"]
