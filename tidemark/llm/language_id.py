"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its
letters' vectors, permuted by their place (rotated by 2, 1 and 0), with an
elementwise product. A text's vector bundles (adds) the vectors of all its
trigrams; a language's prototype bundles those of its training texts. The
prototype with the largest cosine names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, with_id

DIMENSIONS, SEED = 1024, 20_240_601
# Texts are read in blocks of so many characters; their trigram counts add up.
BLOCK = 1_000_000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three code points of 21 bits) and counts of the trigrams of
    letters and word gaps; what stands between letters is one gap, and a gap
    stands before the first and after the last letter. No letter: empty."""
    codes, counts, before = [], [], np.array([32], np.uint32)
    for lo in range(0, len(text), BLOCK):
        points = _points(text[lo:lo + BLOCK])
        points = np.concatenate([before, np.where(_is_letter()[points], points, 32).astype(np.uint32)])
        if lo + BLOCK >= len(text):
            points = np.append(points, np.uint32(32))
        points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))].astype(np.int64)
        if len(points) > 2:
            c, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
            codes.append(c)
            counts.append(n)
        before = points[-2:].astype(np.uint32)
    return _added(codes, counts)


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


class Vectors:
    """Vectors of letters, made from their code point and kept, and of
    trigrams."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.known = np.empty(0, np.int64)
        self.rows = [np.empty((0, dimensions), np.float32)] * 3  # rotated by 2, 1, 0

    def _letters(self, points: np.ndarray) -> None:
        new = np.setdiff1d(points, self.known)
        if len(new):
            if len(self.known) > 20_000:  # bounds a worker's memory
                self.known, self.rows = np.empty(0, np.int64), [r[:0] for r in self.rows]
                new = np.unique(points)
            made = np.stack([np.random.default_rng([self.seed, int(p)]).integers(0, 2, self.dimensions)
                             for p in new]).astype(np.float32) * 2 - 1
            order = np.argsort(known := np.concatenate([self.known, new]))
            self.known = known[order]
            self.rows = [np.concatenate([r, np.roll(made, shift, 1)])[order]
                         for r, shift in zip(self.rows, (2, 1, 0))]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
        self._letters(np.unique(np.concatenate(parts)))
        first, second, third = (r[np.searchsorted(self.known, p)] for r, p in zip(self.rows, parts))
        first *= second
        first *= third
        return first

    def bundled(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float64)
        for lo in range(0, len(codes), 4096):
            total += counts[lo:lo + 4096].astype(np.float64) @ self.bound(codes[lo:lo + 4096])
        return total

    def texts(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Vectors of several texts, one per row."""
        out = np.zeros((len(grams), self.dimensions), np.float32)
        found, at = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
        row = np.repeat(np.arange(len(grams)), [len(c) for c, _ in grams])
        count = np.concatenate([n for _, n in grams]).astype(np.float32)
        for lo in range(0, len(found), 4096):
            own = (at >= lo) & (at < lo + 4096)
            some = np.zeros((len(grams), min(4096, len(found) - lo)), np.float32)
            some[row[own], at[own] - lo] = count[own]
            out += some @ self.bound(found[lo:lo + 4096])
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype vector of each language of the rows given.

    Rows without a language or without a letter teach nothing. Each task adds
    up trigram counts by language and sends one vector per language; Spark
    adds these, so the driver gets languages x dimensions numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                codes, counts = sums.setdefault(lang, ([], []))
                for whole, part in zip((codes, counts), trigrams(text.as_py())):
                    whole.append(part)
                if sum(map(len, codes)) > 2_000_000 or len(codes) > 2_000:
                    sums[lang] = tuple([x] for x in _added(codes, counts))
        vectors = Vectors()
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([vectors.bundled(*_added(codes, counts))], pa.list_(pa.float64()))],
                ["lang", "vector"])

    ship(docs.sparkSession)
    rows = (docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .where("text IS NOT NULL AND lang IS NOT NULL"))
    sums = (rows.mapInArrow(run, "lang string, vector array<double>")
            .select("lang", F.posexplode("vector").alias("at", "value"))
            .groupBy("lang", "at").agg(F.sum("value").alias("value")).collect())
    prototypes: dict[str, np.ndarray] = {}
    for lang, at, value in sums:
        prototypes.setdefault(lang, np.zeros(DIMENSIONS))[at] = value
    return {k: v for k, v in sorted(prototypes.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (cosine with the winning
    prototype, negative ones as 0).

    A text that is null or has no letter is ``und`` with score 0, as is any
    text without prototypes; of equal cosines the language first in order
    wins. Texts of any length are read whole. Repeated rows and null ids are
    predicted like any other; further columns are ignored.
    """
    ship(docs.sparkSession)
    langs = list(prototypes)
    unit = (np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in langs]).astype(np.float32)
            if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                grams = [trigrams(t.as_py() or "") for t in part.column("text")]
                best, score = [UNDETERMINED] * len(grams), [0.0] * len(grams)
                some = [i for i, (c, _) in enumerate(grams) if len(c)] if langs else []
                if some:
                    texts = vectors.texts([grams[i] for i in some])
                    norm = np.maximum(np.linalg.norm(texts, axis=1), 1e-12)
                    cosine = texts @ unit.T / norm[:, None]
                    for i, row in zip(some, cosine):
                        best[i], score[i] = langs[int(row.argmax())], min(1.0, max(0.0, float(row.max())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    ["_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, with_id(rows, "lang_pred string, score double"))
            .withColumnRenamed("_id", id_col))
