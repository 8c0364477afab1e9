import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(row):
    return list(memoryview(row.ids).cast("I")) if row.ids else []


def check(make_docs, rows, ranks, library, **sizes):
    encoded = bpe.encode(make_docs(rows), ranks, public_tokenizers.PATTERN, **sizes)
    got = bpe.decode(encoded, ranks).collect()
    key = str
    assert sorted(((r.doc_id, ids_of(r), bytes(r.bytes)) for r in got), key=key) == sorted(
        ((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=key)


def test_as_the_library(make_docs, odd_rows, ranks, library):
    check(make_docs, odd_rows + [(20, "<|endoftext|> is text")], ranks, library)


def test_chunks_are_stitched(make_docs, odd_rows, ranks, library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "bc", " ", "  ", "\n", "'s", "7", "é", "日", "!", "?!", "'", "\r\n"], k=900))
             for _ in range(30)]
    runs = ["a" * 700, "a " * 10 + "b" * 500 + " tail of words" * 30, " " * 300 + "x", "12" * 400, "\n" * 333 + " y" * 99]
    rows = [(100 + k, t) for k, t in enumerate([*texts, *runs, runs[1]])]
    check(make_docs, rows, ranks, library, chunk=64, overlap=16)
    check(make_docs, rows + odd_rows, ranks, library, chunk=1000, overlap=100)


def test_reads_ranks(spark, ranks):
    assert bpe.read_ranks(spark, PATH) == ranks
    assert bpe.read_ranks(spark, f"file://{PATH}") == ranks


def test_empty_table(make_docs, ranks):
    assert bpe.encode(make_docs([]), ranks, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merge_like_the_library(text):
    if not hasattr(test_merge_like_the_library, "held"):
        r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        e = tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r, special_tokens={})
        test_merge_like_the_library.held = r, e
    r, e = test_merge_like_the_library.held
    if text:
        assert bpe.merge(text.encode(), r) == e._encode_single_piece(text)
