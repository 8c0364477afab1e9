"""Near duplicates by SetSketch registers, confirmed on full shingle sets.

A document's set is its distinct k-word shingles. For each register a hash of
every shingle is an exponential variable; the register keeps the smallest,
rounded to an exponent of b (so the registers of a union are the larger ones
of its parts, and two registers agree about as often as the Jaccard
similarity says). Bands of registers give buckets; documents that share a
bucket are candidates. Within a cluster of candidates, register comparisons
give a joint likelihood whose maximum estimates the similarity; pairs that it
leaves open are confirmed by intersecting full sets.

Equal sets are one class from the start, so exact copies cost one row per
task. Buckets send each member to its smallest member only; candidate
clusters are the components of these stars. A cluster is compared in blocks
of bounded size, block by block in parallel; inside a block pair every two
classes that are not connected yet are judged, and only links that connect
something new are emitted. No pair of similarity t is lost but with
probability (1 - t^ROWS)^BANDS: below 1e-6 at 0.8 and 1e-10 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import ship, with_id, written
from tidemark.llm.components import components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
# Register scale: base, rate of the exponentials, largest value.
BASE, RATE, LARGEST = 1.001, 20.0, 65_535
MULTIPLIERS = np.random.default_rng(6).integers(0, 2 ** 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
# Bytes of shingle hashes in a block of a cluster, and of text that are scanned
# for words at a time.
BLOCK_BYTES, SCAN_BYTES = 1 << 20, 1 << 20
# Random values of the bytes (A-Z have those of a-z) and their odd base.
BYTE_VALUES = np.random.default_rng(7).integers(0, 2 ** 63, 257, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE, BYTE_VALUES = BYTE_VALUES[256], BYTE_VALUES[:256]
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words in order: the sum over a word's bytes of a
    random value of the byte times a power of an odd number, by its place."""
    out = [np.empty(0, np.uint64)]
    lo = 0
    while lo < len(raw):
        hi = min(lo + SCAN_BYTES, len(raw))
        while hi < len(raw) and not IS_SPACE[raw[hi]]:  # a word stays whole
            hi += 1
        part = np.frombuffer(raw, np.uint8, hi - lo, lo)
        inside = ~IS_SPACE[part]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            lengths = ends - starts
            own = part[inside]
            first = np.cumsum(lengths) - lengths
            place = np.arange(len(own)) - np.repeat(first, lengths)
            out.append(_mixed(np.add.reduceat(BYTE_VALUES[own] * _powers(int(lengths.max()))[place], first)
                              + lengths.astype(np.uint64)))
        lo = hi
    return np.concatenate(out)


def _powers(n: int, known: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006  kept per worker
    if len(known[0]) < n:
        more = np.full(max(n, 256), BYTE_BASE, np.uint64)
        more[0] = 1
        known[0] = np.multiply.accumulate(more)
    return known[0]


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles (A-Z hash
    like a-z); fewer words are one shingle; without words none."""
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    width = min(width, len(h))
    out = h[:len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = _mixed(out) + h[k:len(h) - width + 1 + k]
    return np.unique(_mixed(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty (uint16)."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 512):
        np.minimum(least, (MULTIPLIERS[:, None] * shingles[lo:lo + 512]).min(1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0 ** -64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def _compared(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> tuple:
    above, below = (others < one).sum(1), (others > one).sum(1)
    u = size / (size + sizes)
    return above, below, REGISTERS - above - below, u, 1 - u


def _slope(compared: tuple, j: np.ndarray) -> np.ndarray:
    """Slope at similarity j of the log likelihood of the comparisons, which
    is concave: registers differ upwards with probability p(u - vj), downwards
    with p(v - uj), where p(x) = -log_b(1 - x(b - 1)/b)."""
    above, below, same, u, v = compared
    c = (BASE - 1) / BASE
    up, down = u - v * j, v - u * j
    p_up, p_down = (-np.log1p(-c * x) / np.log(BASE) for x in (up, down))
    d_up, d_down = (-w * c / (1 - c * x) / np.log(BASE) for w, x in ((v, up), (u, down)))
    tiny = 1e-12
    return (above * d_up / np.maximum(p_up, tiny) + below * d_down / np.maximum(p_down, tiny)
            - same * (d_up + d_down) / np.maximum(1 - p_up - p_down, tiny))


def estimate(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similarity of the set with registers ``one`` to each of ``others`` that
    makes the register comparisons likeliest, given the sets' sizes."""
    compared = _compared(one, size, others, sizes)
    lo, hi = np.zeros(len(sizes)), np.minimum(size / sizes, sizes / size)
    for _ in range(40):
        mid = (lo + hi) / 2
        up = _slope(compared, mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def estimated_at_least(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, j: float) -> np.ndarray:
    """Whether ``estimate`` is at least j: the likelihood still rises there."""
    return _slope(_compared(one, size, others, sizes), np.minimum(j, 0.999 * np.minimum(size / sizes, sizes / size))) >= 0


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Columns _id, n, set_hash (128 bits; null for an empty set), registers."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, whole, sketch = [], [], []
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), width)
                    n.append(len(s))
                    whole.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketch.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()),
                     pa.array(sketch, pa.binary())], ["_id", "n", "set_hash", "registers"])

    return rows.mapInArrow(run, with_id(rows, "n long, set_hash binary, registers binary"))


def _links(kind: str, width: int, percent: int):
    """mapInArrow function over rows sorted by cluster, one, two: verified
    links (a, b) that connect what was not connected in that block pair."""
    spread = (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def judge(rows: list[tuple]) -> list[tuple]:
        entries = {}
        for _, one, two, block, node, n, whole, sketch, text in rows:
            s = shingle_set(text, width)
            if len(s) == n and xxhash.xxh3_128_digest(s.tobytes()) == whole:  # else another text of this id
                entries[whole] = (node, block, s, np.frombuffer(sketch, np.uint16))
        one, two = rows[0][1], rows[0][2]
        nodes, blocks, sets, sketches = map(list, zip(*entries.values())) if entries else ([], [], [], [])
        if len(nodes) < 2:
            return []
        sizes, sketches, blocks = np.array([len(s) for s in sets]), np.stack(sketches), np.array(blocks)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(flat, np.cumsum(sizes)[:-1])
        mark, group, out = np.zeros(flat.max() + 1, np.int64), np.arange(len(nodes)), []
        for i in np.argsort(-sizes, kind="stable"):
            rest = (group != group[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            rest &= (blocks != blocks[i]) if one != two else (np.arange(len(nodes)) != i)
            rest = np.flatnonzero(rest)
            if not len(rest):
                continue
            rest = rest[estimated_at_least(sketches[i], sizes[i], sketches[rest], sizes[rest], percent / 100 - 7 * spread)]
            if not len(rest):
                continue
            mark[own[i]] = 1
            starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
            shared = np.add.reduceat(mark[np.concatenate([own[j] for j in rest])], starts)
            mark[own[i]] = 0
            for j in rest[100 * shared >= percent * (sizes[i] + sizes[rest] - shared)]:
                if group[j] != group[i]:
                    out.append((nodes[i], nodes[j]))
                    group[group == group[j]] = group[i]
        return out

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        names = ("cluster", "one", "two", "block", "_id", "n", "set_hash", "registers", "text")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield from zip(*(part.column(c).to_pylist() for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for _, rows in groupby(rows_of(batches), key=lambda r: r[:3]):
            found += judge(list(rows))
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*found)], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| of
    their sets of ``width``-word shingles (lower-cased A-Z; fewer words are
    one shingle). ``component_id`` is the smallest id reachable by links,
    itself included, and ``kept`` marks it. A null text counts as empty; an
    empty set is linked with nothing. Rows with a null id are linked with
    nothing either: component null, kept. Repeated rows of one id are one
    document and marked alike; several texts under one id link it by each of
    them. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    signed = written(signatures(docs, id_col, text_col, width), "signatures")
    linkable = signed.where("n > 0 AND _id IS NOT NULL")
    classes = written(linkable.groupBy("set_hash").agg(F.min(F.struct("_id", "n", "registers")).alias("least"))
                      .select("set_hash", "least.*"), "classes")

    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)])
    buckets = classes.select("_id", F.explode(keys).alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("_id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    clusters = components(buckets.join(hubs.select("key", "hub"), "key"), "hub", "_id")

    members = classes.join(clusters.select(F.col("node").alias("_id"), F.col("root").alias("cluster")), "_id")
    parts = (members.groupBy("cluster").agg(F.sum(8 * F.col("n")).alias("bytes"))
             .select("cluster", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("parts")))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Block k meets every block once: as the first of a pair or the second.
    placed = (members.join(parts, "cluster").join(texts, "_id")
              .withColumn("block", F.pmod(F.xxhash64("set_hash"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
              .select("cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                      "block", "_id", "n", "set_hash", "registers", "text"))
    kind = docs.select(F.col(id_col).alias("_id")).schema["_id"].dataType
    links = (placed.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two")
             .mapInArrow(_links(to_arrow_type(kind), width, percent), f"a {kind.simpleString()}, b {kind.simpleString()}"))
    roots = components(links, "a", "b")

    labelled = classes.select("set_hash", "_id").join(
        roots.select(F.col("node").alias("_id"), "root"), "_id", "left").select(
        "set_hash", F.coalesce("root", "_id").alias("component"))
    own = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return (signed.select("_id", "n", F.when(F.col("_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
            .join(labelled, "set_hash", "left")
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                    F.col("_id").eqNullSafe(own).alias("kept")))
