"""Toxicity by a counterfactual-regularised linear classifier.

Features say which character 4- to 6-grams of words occur in a text. The
logistic loss gets a penalty on counterfactual pairs: a labelled sentence that
mentions a group, and the same sentence with that mention swapped for another
group of its kind, must score alike. What distinguishes the two is the name
of the group alone, so names of groups lose their weight even where they
stand more often in toxic texts, and neutral mentions are not flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, with_id

# Terms of one row name groups of one kind in one language.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "foreigners", "refugees", "natives"), ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einheimische"), ("schwule", "lesben", "heterosexuelle"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "étrangers", "réfugiés"), ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "extranjeros", "refugiados"),
)
SIZES = (4, 5, 6)
BUCKETS = 1 << 20
# Features kept, the positive texts that each needs, and counterfactual pairs
# that a fit takes at most.
FEATURES, LEAST_TEXTS, PAIRS = 1_024, 5, 20_000
BLOCK = 1_000_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"\w+")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of each word with a gap at either end, repeats
    included; a very long text comes in blocks that overlap."""
    out = [np.empty(0, np.int64)]
    for lo in range(0, len(text) + 1, BLOCK):
        hi = lo + BLOCK + SIZES[-1]
        part = (" " if lo == 0 else text[lo - 1]) + text[lo:hi] + " " * (hi >= len(text))
        points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[points]
        points = np.where(letter, points, 32).astype(np.uint64)
        h, inner = points.copy(), np.ones(len(points), bool)
        for n in range(2, SIZES[-1] + 1):
            if len(points) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:]
            inner = inner[:-1] & letter[n - 2:len(letter) - 1] if n > 2 else inner[:-1]
            if n in SIZES:
                mixed = (h[inner] ^ (h[inner] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed >> np.uint64(44)).astype(np.int64))
    return np.concatenate(out)


def swapped(sentence: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[str]:
    """The sentence with each mention of a group swapped for the others of
    its kind, one mention and one other group at a time."""
    others = {t: [o for o in row if o != t] for row in terms for t in row}
    return [sentence[:m.start()] + o + sentence[m.end():]
            for m in WORDS.finditer(sentence) for o in others.get(m.group().lower(), ())]


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        weight = np.zeros(BUCKETS, np.float32)
        weight[self.buckets] = self.weights
        return weight


def _score(weight: np.ndarray, intercept: float, text: str) -> float:
    found = grams(text)
    found = np.unique(found[weight[found] != 0])
    z = intercept + float(np.sum(weight[found], dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _counts(sample: DataFrame) -> np.ndarray:
    """Bucket, texts of label 1, texts of label 0 that hold it: the features
    worth keeping, at most FEATURES, by chi-square."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                held[int(label > 0), np.unique(grams(text.as_py()))] += 1
        some = np.flatnonzero(held.any(0))
        for lo in range(0, len(some), 100_000):
            own = some[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[1, own]), pa.array(held[0, own])],
                                             ["bucket", "pos", "neg"])

    n1 = sample.where("label > 0").count()
    n0 = sample.count() - n1
    if not n1 or not n0:
        return np.empty(0, np.int64)
    p, n, one, zero = F.col("pos"), F.col("neg"), F.lit(float(n1)), F.lit(float(n0))
    chi = ((p * zero - n * one) ** 2 * (one + zero)
           / (one * zero * (p + n) * (one + zero - p - n + F.lit(1e-9))))
    best = (sample.mapInArrow(run, "bucket long, pos long, neg long")
            .groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where((p >= LEAST_TEXTS) & (p * zero > n * one))
            .orderBy(chi.desc(), "bucket").limit(FEATURES).select("bucket").collect())
    return np.sort(np.array([r[0] for r in best], np.int64))


def _rows(sample: DataFrame, buckets: np.ndarray, terms, most_pairs: int) -> list:
    """Per text: label, features (places in ``buckets``); per counterfactual
    pair: label null, features of the sentence, of its swapped form."""
    def places(text: str) -> np.ndarray:
        found = np.unique(grams(text))
        at = np.searchsorted(buckets, found)
        return at[(at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == found)]

    known = {t for row in terms for t in row}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, one, other = [], [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                label.append(int(y > 0))
                one.append(places(text))
                other.append(None)
                if known.isdisjoint(w.lower() for w in WORDS.findall(text)):
                    continue
                for sentence in SENTENCE.findall(text):
                    for twin in swapped(sentence, terms):
                        label.append(None)
                        one.append(places(sentence))
                        other.append(places(twin))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(one, kind), pa.array(other, kind)],
                                             ["label", "one", "other"])

    rows = sample.mapInArrow(run, "label int, one array<long>, other array<long>")
    texts = rows.where("label IS NOT NULL").collect()
    pairs = rows.where("label IS NULL AND one != other").orderBy(F.xxhash64("one", "other")).limit(most_pairs).collect()
    return [*texts, *pairs]


def fit(sample: DataFrame, penalty: float = 10.0, ridge: float = 1e-5, steps: int = 400,
        terms: Sequence[Sequence[str]] = IDENTITY_TERMS, most_pairs: int = PAIRS) -> Model:
    """Fit on a bounded sample with columns text, label (``labelled.sample``).

    The driver receives the kept features of each sampled text and of the
    counterfactual pairs of its labelled rows: of ``most_pairs`` at most, taken
    by a hash of the pair, which bounds the fit as the sample's rows do. ``penalty`` weighs the mean squared difference
    of the two scores of a pair. Without texts of both labels the model is
    constant: the share of label 1 (one half without any text).
    """
    ship(sample.sparkSession)
    buckets = _counts(sample)
    if not len(buckets):
        n, y = sample.selectExpr("count(*)", "coalesce(sum(int(label > 0)), 0)").first()
        rate = (y + 0.5) / (n + 1)
        return Model(buckets, np.empty(0), float(np.log(rate / (1 - rate))))
    rows = _rows(sample, buckets, terms, most_pairs)
    texts, pairs = [r for r in rows if r[0] is not None], [r for r in rows if r[0] is None]

    def sparse(sets):
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([c for s in sets for c in s], np.int64)

    y, f = np.array([r[0] for r in texts], np.float64), len(buckets)
    row, col = sparse([r[1] for r in texts])
    prow, pcol = sparse([[*r[1], *r[2]] for r in pairs])
    sign = np.array([s for r in pairs for s in [1.0] * len(r[1]) + [-1.0] * len(r[2])])
    w, b = np.zeros(f), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v = np.zeros(f + 1), np.zeros(f + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(row, w[col], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(col, error[row], f) + ridge * w
        if pairs:
            gap = np.bincount(prow, sign * w[pcol], len(pairs))
            grad += penalty * 2 / len(pairs) * np.bincount(pcol, sign * gap[prow], f)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 / (1 + t / 100) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(buckets, w, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1; higher: toxic is likelier).

    Null and empty texts score as a text without any feature. Texts of any
    length are read whole. Repeated rows and null ids are scored like any
    other; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.table()
        for batch in batches:
            scores = [_score(weight, model.intercept, t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores, pa.float64())], ["_id", "score"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, with_id(rows, "score double")).withColumnRenamed("_id", id_col)
