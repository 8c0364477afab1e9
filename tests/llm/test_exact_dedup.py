import hashlib

import pytest

from tidemark.llm.common import lowered
from tidemark.llm.exact_dedup import exact_duplicates


def brute(rows, pick):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t or ""), []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[lowered(t or "")]
        keep = pick([x for x in own if x is not None], default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lowered(t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_against_brute_force(make_docs, odd_rows, keep, pick):
    rows = odd_rows + [(k, "hot copy") for k in range(100, 160)] + [(200, "ÄÖ"), (201, "äö")]
    got = exact_duplicates(make_docs(rows), keep=keep).collect()
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, pick), key=key)


def test_empty_table(make_docs):
    assert exact_duplicates(make_docs([])).collect() == []
