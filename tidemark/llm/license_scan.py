"""Licence passages by a positional index of rare words.

The index lists where each word stands in each template. How rare a word is,
the corpus says: its inverse document frequency over all documents. Every
template is found by its rarest positions, its anchors: the anchors among a
file's words are looked up, each lookup says where in the file the template
would begin, and lookups that agree about that place (within a few words, as
words may be missing or added) are intersected. Where enough anchors of a
template agree, its key phrases are verified word by word and the share of its
words that stand at their place is its score. Phrases of the base search are
templates of which every word must fit.

Anchors are per template, so no bound on lookups per file can lose one. Texts
are read in blocks that overlap by the longest template.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, with_id
from tidemark.llm.license_texts import BASE_PHRASES, TEMPLATES, Template
from tidemark.llm.textblocks import alnum_words

# Anchors of a template, the share of them that must agree about its place, the
# words by which they may be apart, and the least share of words at their place.
ANCHORS, AGREE, DRIFT, LEAST_SHARE = 12, 0.6, 8, 0.8
PLACE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()),
                   ("share", pa.float64())])


def words_of(text: str) -> tuple[bytes, ...]:
    return tuple(w for words in alnum_words(text.encode()) for w in words)


def idf(docs: DataFrame, vocabulary: Sequence[bytes], text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of each word of ``vocabulary`` over all rows
    of ``docs``. A task sends one row per word, the driver gets as many."""
    ship(docs.sparkSession)
    known = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for raw in batch.column("raw"):
                own = set()
                for words in alnum_words(raw.as_py()):
                    own |= known.intersection(words)
                found.update(own)
        found[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())],
                                         ["word", "n"])

    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw")
    n = {bytes(word): n for word, n in docs.select(raw).mapInArrow(run, "word binary, n long")
         .groupBy("word").agg(F.sum("n")).collect()}
    return {w: math.log((n.get(b"", 0) + 1) / (n.get(w, 0) + 1)) for w in known}


class Index:
    """Postings of the anchors of templates and phrases."""

    def __init__(self, templates: Sequence[Template], phrases: dict[str, str], rarity: dict[bytes, float]):
        self.entries = []  # label, base, words, key phrases, anchors that must agree
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # word -> entry, position
        for label, text, keys, base in [*((*t, False) for t in templates),
                                        *((label, p, (), True) for label, p in phrases.items())]:
            words = words_of(text)
            if not words:
                raise ValueError(f"no word in {label}")
            rarest = sorted(range(len(words)), key=lambda p: (-rarity.get(words[p], 0.0), p))
            rarest = rarest[:1 if base else ANCHORS]
            for p in rarest:
                self.postings[words[p]].append((len(self.entries), p))
            self.entries.append((label, base, words, tuple(words_of(k) for k in keys),
                                 len(rarest) if base else math.ceil(AGREE * len(rarest))))
        self.postings = dict(self.postings)
        self.longest = max((len(e[2]) for e in self.entries), default=0) + 2 * DRIFT

    def places(self, words: Sequence[bytes]) -> Iterator[tuple[int, int, float]]:
        """(entry, start, share) of every passage found in ``words``."""
        agreeing: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                for entry, p in self.postings[w]:
                    agreeing[entry].append((i - p, p))
        for entry, votes in agreeing.items():
            _, base, own, keys, least = self.entries[entry]
            if base:
                for start, _ in votes:
                    if start >= 0 and tuple(words[start:start + len(own)]) == own:
                        yield entry, start, 1.0
                continue
            votes.sort()
            lo, held = 0, Counter()
            best: tuple[float, int] | None = None  # of the passage at hand
            for start, p in votes:
                held[p] += 1
                while start - votes[lo][0] > DRIFT:
                    gone = votes[lo][1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    lo += 1
                if best and start - best[1] > DRIFT:  # the next passage
                    yield entry, best[1], best[0]
                    best = None
                if len(held) >= least and self._has_keys(words, start, len(own), keys):
                    share = self._share(words, start, own)
                    if share >= LEAST_SHARE and (best is None or share > best[0]):
                        best = (share, start)
            if best:
                yield entry, best[1], best[0]

    @staticmethod
    def _has_keys(words: Sequence[bytes], start: int, length: int, keys) -> bool:
        lo, hi = max(0, start - DRIFT), start + length + DRIFT
        return all(any(tuple(words[i:i + len(k)]) == k for i in range(lo, min(hi, len(words)) - len(k) + 1))
                   for k in keys)

    @staticmethod
    def _share(words: Sequence[bytes], start: int, own: tuple[bytes, ...]) -> float:
        """Share of the template's words that stand at their place, give or take DRIFT."""
        at = defaultdict(list)
        for i in range(max(0, start - DRIFT), min(len(words), start + len(own) + DRIFT)):
            at[words[i]].append(i - start)
        return sum(any(abs(i - p) <= DRIFT for i in at[w]) for p, w in enumerate(own)) / len(own)


def find(index: Index, raw: bytes) -> tuple[int, list[tuple[int, int, float]]]:
    """Words of a text and (entry, first word, share) of the passages in it,
    by first word."""
    n, tail, found = 0, [], {}
    for words in alnum_words(raw):
        first, window = n - len(tail), tail + words
        for entry, start, share in index.places(window):
            at = (entry, max(0, first + start))
            found[at] = max(share, found.get(at, 0.0))
        n += len(words)
        tail = window[-index.longest:] if index.longest else []
    return n, sorted(((e, i, s) for (e, i), s in found.items()), key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, rarity: dict[bytes, float] | None = None, templates: Sequence[Template] = TEMPLATES,
         phrases: dict[str, str] = BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words and ``places``, an array of (label,
    base, first, words, share) by first word; words count from 0.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters
    above ASCII. ``base`` marks the places of the phrases, all of them. The
    rarity of words is that in ``docs`` unless given (``idf``). A null text has
    no words and no places; ids may be null or repeated, and repeated rows stay
    rows. An empty table gives no rows; further columns are ignored.
    """
    ship(docs.sparkSession)
    if rarity is None:
        rarity = idf(docs, sorted({w for t in [*(t.text for t in templates), *phrases.values()] for w in words_of(t)}),
                     text_col)
    index = Index(templates, phrases, rarity)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw")
    rows = docs.select(F.col(id_col).alias("_id"), raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n_words, places = zip(*(find(index, raw.as_py()) for raw in part.column("raw")))
                named = [[dict(zip(("label", "base", "first", "words", "share"),
                                   (index.entries[e][0], index.entries[e][1], i, len(index.entries[e][2]), share)))
                          for e, i, share in own] for own in places]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(n_words, pa.int64()), pa.array(named, pa.list_(PLACE))],
                    ["_id", "n_words", "places"])

    ddl = "n_words long, places array<struct<label string, base boolean, first long, words long, share double>>"
    return rows.mapInArrow(run, with_id(rows, ddl)).withColumnRenamed("_id", id_col)
