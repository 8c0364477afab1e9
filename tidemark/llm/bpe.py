"""Byte-level BPE: encoding in overlapping chunks, decoding by concatenation.

A text of at most ``chunk`` characters is one chunk. A longer one is cut into
chunks that overlap; they are pre-tokenised in parallel, each from its own
start. Where the pre-token boundaries of two neighbours first agree in their
overlap both are in step, and the later chunk takes over there. A pre-token
pattern that looks only ahead makes this exact: two scans that share one
boundary share all later ones. The stitched pieces are then encoded in
parallel. If a chunk never falls in step inside its overlap (one run of
letters that is longer, say), it and all later chunks of that text are
scanned again as one piece from the last sure boundary.

Merges work per pre-token: the pair with the lowest rank first, the leftmost
of equals. Distinct pre-tokens recur, so each worker remembers their ids up
to a bound.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship

CHUNK, OVERLAP = 65_536, 1_024
# Pre-tokens that a worker remembers, and their longest form.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, space, rank per line. The
    vocabulary's size bounds what is read here and broadcast."""
    lines = open(path, "rb").read().split(b"\n") if "://" not in path else [
        r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. The queue holds candidate pairs by (rank, place);
    n bytes cost n log n, so a very long pre-token stays affordable."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # parts start at 0..n-1
    alive = bytearray(b"\x01") * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        mid = end[i]
        if not alive[i] or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        alive[mid], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(queue, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class _Packed(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in merge(piece.encode(), self.ranks))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def _encoder(ranks_b, pattern: str, carry: list[str]):
    """mapInArrow function: ``text`` becomes ``ids``, the columns ``carry``
    stay. Of a segment, ``skip`` characters go before and what lies beyond the
    next ``chars`` goes after the scan, which thus sees what follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packed = regex.compile(pattern).findall, _Packed(ranks_b.value)

        def segment(text: str, skip: int, chars: int) -> list[str]:
            found, beyond = pieces(text, skip), len(text) - skip - chars
            while beyond > 0:
                beyond -= len(found.pop())
            return found

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column("text").to_pylist()
                if "skip" in part.schema.names:
                    found = map(segment, texts, part.column("skip").to_pylist(), part.column("chars").to_pylist())
                else:
                    found = map(pieces, texts)
                ids = [b"".join(map(packed.__getitem__, x)) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), pa.array(ids, pa.binary())], [*carry, "ids"])
    return run


def _cutter(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                for lo in range(0, len(text), chunk * 64):
                    own = range(lo, min(lo + chunk * 64, len(text)), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(c)[row].as_py()] * len(own), batch.column(c).type)
                         for c in ("_key", "_id")]
                        + [pa.array([s // chunk for s in own], pa.int64()),
                           pa.array([len(text)] * len(own), pa.int64()),
                           pa.array([text[s:s + chunk + overlap] for s in own], pa.string())],
                        ["_key", "_id", "chunk", "length", "text"])
    return run


def _scanner(pattern: str, chunk: int, overlap: int):
    """Adds the boundaries in the chunk's own first ``overlap`` characters and
    in those of its successor, as places in the whole text. A match that
    reaches the cut end may change with what follows, but where it starts is
    sure."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finditer = regex.compile(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for k, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist()):
                at = [m.start() for m in finditer(text)]
                heads.append([k * chunk + i for i in at if i < overlap])
                tails.append([k * chunk + i for i in at if i >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "head", "tail"])
    return run


def _long_texts(rows: DataFrame, kind: str, pattern: str, ranks_b, chunk: int, overlap: int) -> DataFrame:
    """Ids of texts that are longer than a chunk."""
    columns = f"_key long, _id {kind}, chunk long, length long, text string"
    chunks = (rows.withColumn("_key", F.monotonically_increasing_id())
              .mapInArrow(_cutter(chunk, overlap), columns)
              .repartition("_key", "chunk")
              .mapInArrow(_scanner(pattern, chunk, overlap), columns + ", head array<long>, tail array<long>"))
    order = Window.partitionBy("_key").orderBy("chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    agreed = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    stitched = (chunks.withColumn("begin", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(agreed))
                .withColumn("sure", F.min(F.col("begin").isNotNull()).over(upto))
                .withColumn("segment", F.sum(F.col("sure").cast("int")).over(upto)))
    # The overlap repeats the next chunk's start: a segment of several chunks
    # takes it from its last chunk only.
    own = F.expr("transform(sort_array(parts), (p, i) -> "
                 f"IF(i < size(parts) - 1, substr(p.text, 1, {chunk}), p.text))")
    following = Window.partitionBy("_key").orderBy("segment")
    segments = (stitched.groupBy("_key", "_id", "segment")
                .agg(F.min("chunk").alias("chunk"), F.min("length").alias("length"),
                     F.min(F.when(F.col("sure"), F.col("begin"))).alias("begin"),
                     F.collect_list(F.struct("chunk", "text")).alias("parts"))
                .withColumn("end", F.coalesce(F.lead("begin").over(following), F.col("length")))
                .select("_key", "_id", "segment", F.concat_ws("", own).alias("text"),
                        (F.col("begin") - F.col("chunk") * chunk).alias("skip"),
                        (F.col("end") - F.col("begin")).alias("chars")))
    encoded = (segments.repartition("_key", "segment")
               .mapInArrow(_encoder(ranks_b, pattern, ["_key", "_id", "segment"]),
                           f"_key long, _id {kind}, segment long, ids binary"))
    joined = "unhex(array_join(transform(sort_array(parts), p -> hex(p.ids)), ''))"
    return (encoded.groupBy("_key", "_id").agg(F.collect_list(F.struct("segment", "ids")).alias("parts"))
            .select("_id", F.expr(joined).alias("ids")))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, ids (binary, little-endian unsigned 32-bit).

    ``pattern`` must cover every character and look ahead only. A null text
    counts as empty and gives no ids; texts of any length are whole. Repeated
    rows and null ids are encoded like any other. An empty table gives no
    rows; further columns are ignored. The special tokens of a vocabulary are
    ordinary text here.
    """
    ship(docs.sparkSession)
    ranks_b = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()

    short = rows.where(F.length("text") <= chunk).mapInArrow(
        _encoder(ranks_b, pattern, ["_id"]), f"_id {kind}, ids binary")
    long = _long_texts(rows.where(F.length("text") > chunk), kind, pattern, ranks_b, chunk, overlap)
    return short.unionByName(long).select(F.col("_id").alias(id_col), "ids")


def decode(tokens: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, ids, bytes (the tokens' bytes, one after the
    other; no ids give no bytes)."""
    ship(tokens.sparkSession)
    vocabulary = tokens.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary.value.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [b"".join(map(token, memoryview(x).cast("I"))) if x else b""
                       for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("ids"), pa.array(raw, pa.binary())], ["_id", "ids", "bytes"])

    return (tokens.select(F.col(id_col).alias("_id"), "ids")
            .mapInArrow(run, f"_id {kind}, ids binary, bytes binary").withColumnRenamed("_id", id_col))
