"""Licence scans against a plain search, and templates planted in texts."""

import re

import pytest

from tidemark.llm import license_scan as L
from tidemark.llm import textblocks
from tidemark.llm.queries import op12_license_scan

SF = "/root/testdata/sf0.01"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    ws = words(text)
    return sorted((i, label) for label, phrase in L.BASE_PHRASES.items() for i in range(len(ws))
                  if ws[i:i + len(phrase.split())] == phrase.split())


def places(spark, make_docs, rows, **kw):
    return {r.doc_id: (r.n_words, [tuple(p) for p in r.places]) for r in L.scan(make_docs(rows), **kw).collect()}


def filler(n):
    return " ".join(f"zq{k % 89}" for k in range(n))


@pytest.mark.parametrize("sf", [SF])
def test_query_base_as_plain_search(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_license_scan(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 0
    for r in got:
        want = base(docs[r.doc_id])
        labels = sorted({label for _, label in want})
        assert (r.n_words, r.n_base) == (len(words(docs[r.doc_id])), len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(labels) and set(labels) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_every_template_is_found_where_it_stands(spark, make_docs):
    rows = [(k, f"{filler(40)} {t.text} {filler(15)} {t.text}") for k, t in enumerate(L.TEMPLATES)]
    got = places(spark, make_docs, rows)
    for k, t in enumerate(L.TEMPLATES):
        n = len(words(t.text))
        own = [(p[2], p[4]) for p in got[k][1] if not p[1] and p[0] == t.label and p[3] == n]
        assert own == [(40, 1.0), (40 + n + 15, 1.0)], t.label


def test_edited_passages_and_key_phrases(spark, make_docs):
    mit = L.TEMPLATES[0].text.split()
    inserted = " ".join(mit[:40] + ["indeed", "so"] + mit[40:])
    keyless = " ".join(mit).replace("hereby granted", "granted")
    far = " ".join(w for k, w in enumerate(mit) for w in ([w] if k % 2 else [w, "x", "y"]))
    got = places(spark, make_docs, [(1, inserted), (2, keyless), (3, far), (4, " ".join(reversed(mit)))])
    assert [p[0] for p in got[1][1]] == ["mit"] and got[1][1][0][4] > 0.9
    assert got[2][1] == got[3][1] == got[4][1] == []


def test_blocks_of_a_long_text(spark, make_docs, monkeypatch):
    """Passages across the borders of blocks are found once."""
    text = " ".join(filler(k % 7 + 3) + " " + L.TEMPLATES[k % len(L.TEMPLATES)].text + " under the MIT license. "
                    for k in range(40))
    index = L.Index(L.TEMPLATES, L.BASE_PHRASES, {})
    raw = text.encode()
    monkeypatch.setattr(textblocks.blocks, "__defaults__", (700,))
    small = L.find(index, raw)
    monkeypatch.setattr(textblocks.blocks, "__defaults__", (1 << 20,))
    assert L.find(index, raw) == small
    assert [(i, index.entries[e][0]) for e, i, _ in small[1] if index.entries[e][1]] == base(text)


def test_anchors_are_the_rarest_words(spark, make_docs):
    docs = make_docs([(1, "the grant the fee"), (2, "the fee"), (3, None)])
    rarity = L.idf(docs, [b"the", b"grant", b"fee"])
    assert rarity[b"grant"] > rarity[b"fee"] == rarity[b"the"]
    index = L.Index((), {"x": "the grant fee"}, rarity)
    assert list(index.postings) == [b"grant"]


def test_odd_rows(spark, make_docs, odd_rows):
    rows = odd_rows + [(9, "Under THE mit-License; under the mit license"), (None, "cc by nc"), (10, "apache license version 2")]
    got = L.scan(make_docs(rows)).collect()
    assert sorted(r.n_words for r in got) == sorted(len(words(r[1])) for r in rows)
    found = sorted((str(r.doc_id), p.first, p.label) for r in got for p in r.places if p.base)
    assert found == [("10", 0, "apache-2"), ("9", 0, "mit"), ("9", 4, "mit"), ("None", 0, "cc-by-nc")]
    assert L.scan(make_docs([]).limit(0)).collect() == []
