"""Importance resampling towards a target collection, with exact weights.

Every document is a bag of hashed features (runs of one and two words). The
gain of a bucket says how much likelier it is in the target than in the
corpus, in floored thousandths of a natural logarithm; a document's weight is
the floored mean of its features' gains. Documents are drawn without
replacement by the largest weight plus Gumbel noise of their id.

Weights are summed bit by bit: plane i of a document is the set of buckets
whose count has bit i, plane j of the gains the set of buckets whose gain (of
one sign) has bit j; the number of buckets in both, times 2^(i+j), summed over
all pairs of planes, is the exact sum of count times gain.

Counts per document are written once; totals and weights read them instead of
the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, with_id, written
from tidemark.llm.textblocks import alnum_words

BUCKETS = 10_000
# Documents whose planes are held together, and hashes of a text that are held
# before they are counted.
PLANE_DOCS, HELD = 128, 1 << 18


def features(raw: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, the buckets of its features (ascending), their counts."""
    n_words, last, held, totals = 0, None, np.zeros(0, np.int64), None
    for words in alnum_words(raw):
        if not words:
            continue
        single = [crc32(w) for w in words]
        # The hash of "one two" continues that of "one".
        double = [crc32(two, crc32(b" ", one)) for one, two in zip(single, words[1:])]
        if last is not None:
            double.append(crc32(words[0], crc32(b" ", last)))
        n_words, last = n_words + len(words), single[-1]
        held = np.concatenate([held, np.array(single + double, np.int64) % buckets])
        if len(held) > HELD:
            totals = np.bincount(held, minlength=buckets) + (0 if totals is None else totals)
            held = held[:0]
    if totals is None:
        return n_words, *np.unique(held, return_counts=True)
    totals = totals + np.bincount(held, minlength=buckets)
    at = np.flatnonzero(totals)
    return n_words, at, totals[at]


def bucket_counts(docs: DataFrame, id_col: str | None, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """Columns _id, n_words, n_features, buckets, counts, one row per input row."""
    ship(docs.sparkSession)
    key = F.col(id_col) if id_col else F.lit(None).cast("long")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw")
    rows = docs.select(key.alias("_id"), raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n_words, at, counts = zip(*(features(raw.as_py(), buckets) for raw in part.column("raw")))
                ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(n_words, pa.int64()),
                     pa.array([int(c.sum()) for c in counts], pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at), pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts), pa.int64()))],
                    ["_id", "n_words", "n_features", "buckets", "counts"])

    return rows.mapInArrow(run, with_id(rows, "n_words long, n_features long, buckets array<int>, counts array<long>"))


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``bucket_counts``. A task sends one
    row per bucket, the driver gets as many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(own, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in (counts.select("buckets", "counts").mapInArrow(run, "bucket long, n long")
                      .groupBy("bucket").agg(F.sum("n")).collect()):
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Per bucket: floor(scale * ln of its smoothed share in the target over
    that in the corpus)."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _words64(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of every bit of the positive and of the
    negative gains."""
    return [(sign << j, _words64((sign * gain > 0) & (np.abs(gain) >> j & 1 == 1)))
            for sign in (1, -1) for j in range(int(np.abs(gain).max(initial=0)).bit_length())]


def weight_sums(row_of: np.ndarray, at: np.ndarray, counts: np.ndarray, rows: int, n_buckets: int,
                planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of count times gain of ``rows`` documents, whose entries are the
    triples (row, bucket, count)."""
    out = np.zeros(rows, np.int64)
    for i in range(int(counts.max(initial=0)).bit_length()):
        has = counts >> i & 1 == 1
        own, place = np.unique(row_of[has], return_inverse=True)  # rows with this plane
        bits = np.zeros((len(own), n_buckets), bool)
        bits[place, at[has]] = True
        plane = _words64(bits)
        for power, gain in planes:
            out[own] += np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) * power << i
    return out


def weights(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """Columns _id, n_words, n_features, weight: the floored mean gain of a
    document's features; 0 without any."""
    n_buckets, planes = len(gain), gain_planes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PLANE_DOCS):
                part = batch.slice(lo, PLANE_DOCS)
                lists, n = part.column("buckets"), part.num_rows
                total = weight_sums(np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(),
                                    part.column("counts").flatten().to_numpy(), n, n_buckets, planes)
                size = part.column("n_features").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_id", "n_words", "n_features")),
                     pa.array(np.where(size > 0, total // np.maximum(size, 1), 0), pa.int64())],
                    ["_id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(run, with_id(counts, "n_words long, n_features long, weight long"))


def noise(key, seed: int, scale: int = 1000):
    """Floored Gumbel noise of a key: repeatable, the same at any size."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 1 by score (largest first) and id (smallest
    first, null last). Rows are dealt by ranges of (score, id, row), so equal
    rows part where they are many; a range is sorted in its task, and one row
    per task, its count, is gathered to number them on."""
    by = [F.desc("score"), F.asc_nulls_last("_id"), F.asc("row")]
    ordered = written(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                      .withColumn("at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftrightunsigned("at", 33)
    first, offsets = 0, []
    for number, n in sorted(ordered.groupBy(task).count().collect()):
        offsets.append((number, first))
        first += n
    starts = rows.sparkSession.createDataFrame(offsets, "task long, first long")  # one row per task
    return (ordered.join(F.broadcast(starts), task == F.col("task"))
            .withColumn("rank", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1) + 1))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, rank.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters
    above ASCII; features are runs of one and two words, repeats counted. Of
    the N rows with at least ``least_words`` words, floor(percent * N / 100) of
    the highest scores are drawn and ranked from 1; ties go to the smaller id,
    null ids last, and among rows of one id and score in any order. Undrawn
    rows have a null rank. A null text has no words: weight 0. A null id draws
    the noise of the empty text. Repeated rows are drawn each. An empty table
    gives no rows, an empty target none but smoothing; further columns are
    ignored.
    """
    counts = written(bucket_counts(docs, id_col, text_col), "counts")
    gain = gains(totals(counts), totals(bucket_counts(target, None, target_text_col)))
    scored = written(weights(counts, gain).withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
                     .withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    columns = ["_id", "n_words", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    return (_ranked(eligible).select(*columns, rank.alias("rank"))
            .unionByName(scored.where(F.col("n_words") < least_words)
                         .select(*columns, F.lit(None).cast("long").alias("rank")))
            .withColumnRenamed("_id", id_col))
