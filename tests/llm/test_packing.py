import random
from collections import Counter, defaultdict

from tidemark.llm import packing
from tidemark.llm.common import WORD
from tidemark.llm.packing import best_fit, pack


def brute(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(capacity - sum(s for s, *_ in b), k) for k, b in enumerate(bins)
               if capacity - sum(s for s, *_ in b) >= size
               and not any((source is not None and source == y) or (cluster is not None and cluster == z) for _, y, z in b)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        bins[k].append((size, source, cluster))
        out.append(k)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(60):
        pieces = [(rng.randrange(1, 30), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, *range(12)])) for _ in range(80)]
        assert best_fit(pieces, 40) == brute(pieces, 40)


def test_pack(make_docs, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(k, "w " * rng.randrange(300), None, rng.choice("abcdef")) for k in range(100, 400)]
    rows += [(k, "copy of it", None, rng.choice("xyz")) for k in range(500, 540)]
    got = pack(make_docs(rows), capacity=100).collect()
    words = [max(1, len(WORD.findall(t or ""))) for _, t, *_ in rows]
    assert Counter((r.doc_id, r.first_word, r.size) for r in got) == Counter(
        (i, lo, min(100, n - lo)) for (i, *_), n in zip(rows, words) for lo in range(0, n, 100))
    source = {i: s for i, _, _, s in [(*r, None, None)[:4] for r in rows]}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for own in bins.values():
        assert sum(r.size for r in own) <= 100
        assert sorted(r.place for r in own) == list(range(len(own)))
        held = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(held) == len(set(held))
    copies = [r.bin for r in got if r.doc_id and 500 <= r.doc_id < 540]
    assert len(set(copies)) == 40


def test_empty_table(make_docs):
    assert pack(make_docs([])).collect() == []


def test_hot_ids_are_dealt_over_groups(make_docs, monkeypatch):
    """A third of all rows without id, a third equal: groups stay near their size."""
    monkeypatch.setattr(packing, "GROUP_DOCS", 100)
    rows = [(k, f"own {k} " + "w " * (k % 50), None, None) for k in range(1000)]
    rows += [(None, f"none {k} " + "w " * (k % 50), None, None) for k in range(1000)]
    rows += [(7777, "equal", None, None)] * 1000
    got = pack(make_docs(rows), capacity=100).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert Counter(r.size for r in got) == Counter(len(t.split()) for _, t, *_ in rows)
    for own in (got, [r for r in got if r.doc_id is None], [r for r in got if r.doc_id == 7777]):
        sizes = Counter(r.bin >> 32 for r in own)
        assert len(sizes) >= 20 and max(sizes.values()) <= 250
    bins = Counter()
    for r in got:
        bins[r.bin] += r.size
    assert max(bins.values()) <= 100 and len({r.bin for r in got if r.doc_id == 7777}) == 1000


def test_a_group_of_many_pieces_is_packed_as_one(make_docs, monkeypatch):
    """However many pieces are held at a time, small ones find the open bins of
    large ones: as if the group were packed in one go."""
    from tidemark.llm import packing
    pieces = [(size, f"s{k % 7}" if k % 3 else None, f"c{k % 11}" if k % 5 else None)
              for k, size in enumerate(sorted([7, 3, 9, 1, 4, 8, 2, 6] * 40, reverse=True))]
    whole = packing.BestFit(10)
    one = [whole.add(*p) for p in pieces]
    assert [n for n, _ in one] == packing.best_fit(pieces, 10)
    assert set(whole.held) == {n for _, n in whole.open}  # full bins are forgotten
    filled = {}
    for n, place in one:
        assert place == filled.get(n, 0)
        filled[n] = place + 1
