"""Conflict-constrained best-fit packing of documents into bins.

A bin takes at most ``capacity`` words and never two pieces of one source or
of one duplicate cluster. Pieces go largest first into the fullest bin that
can take them: open bins are ordered by what they have left, the search
starts at the smallest residual that suffices and walks up until it meets a
bin whose bitmaps of sources and clusters share no bit with the piece's.
Documents are dealt into groups by a hash of the whole row, repeated rows in
lots, and each group is packed on its own, so packing is parallel, repeatable
and bounded in memory whatever the input, with repeated or null ids too; the
price is at most a few badly filled bins per group.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, ship, with_id

CAPACITY = 2_048
# Documents in a group on average, pieces of a group that are held at a time, and
# equal rows that go to one group together.
GROUP_DOCS, BLOCK_PIECES, LOT = 2_048, 8_192, 16


class BestFit:
    """Bins of one group, filled piece by piece. A full bin is forgotten: only
    open ones are held."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bits: dict[tuple, int] = {}  # source or cluster -> its bit
        self.held: dict[int, list[int]] = {}  # open bin -> bitmap of what it holds, pieces
        self.open: list[tuple[int, int]] = []  # (residual, bin), ordered
        self.bins = 0

    def add(self, size: int, source, cluster) -> tuple[int, int]:
        """Bin of a piece and its place there. Null sources and clusters
        conflict with nothing."""
        mask = 0
        for key in (("source", source), ("cluster", cluster)):
            if key[1] is not None:
                mask |= 1 << self.bits.setdefault(key, len(self.bits))
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open) and self.held[self.open[at][1]][0] & mask:
            at += 1
        if at < len(self.open):
            residual, number = self.open.pop(at)
        else:
            residual, number = self.capacity, self.bins
            self.held[number] = [0, 0]
            self.bins += 1
        own = self.held[number]
        place = own[1]
        if residual > size:
            own[0], own[1] = own[0] | mask, place + 1
            insort(self.open, (residual - size, number))
        else:
            del self.held[number]
        return number, place


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin number of each (size, source, cluster), in the order given."""
    bins = BestFit(capacity)
    return [bins.add(*p)[0] for p in pieces]


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece, pieces, first_word, size, bin, place.

    A document of more than ``capacity`` words is cut into pieces of that
    size and a rest; ``first_word`` says where a piece starts (from 0). A text
    that is null or has no word is one piece of size 1 (its end mark).
    ``cluster_col`` names duplicates of each other; without it texts that are
    equal are. Pieces of one document share its cluster. ``bin`` is unique,
    ``place`` counts a bin's pieces from 0. Ties in size go by id and piece.
    Repeated rows are packed each (in different bins, sharing a cluster);
    a null id, source or cluster is fine. An empty table gives no rows;
    further columns are ignored.
    """
    ship(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / GROUP_DOCS))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(text)
    words = F.regexp_count(text, F.lit(WORD_PATTERN))
    row = ["_id", "source", "cluster", "words"]
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
                        cluster.alias("cluster"), F.greatest(words, F.lit(1)).cast("long").alias("words"))
            .groupBy(*row).agg(F.count("*").alias("copies"))
            .withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {LOT})")))
            .withColumn("pieces", F.ceil(F.col("words") / capacity).cast("long"))
            .withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)")))
            .withColumn("size", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("long"))
            .withColumn("group", F.pmod(F.xxhash64(*row, "lot", "piece"), F.lit(groups))))
    names = ["_id", "piece", "pieces", "size", "group", "source", "cluster"]

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.column("_id").type
                yield batch

        for group, own in groupby(pieces_of(typed(batches)), key=lambda r: r[4]):
            bins = BestFit(capacity)
            while block := list(islice(own, BLOCK_PIECES)):
                numbers, place = zip(*(bins.add(r[3], r[5], r[6]) for r in block))
                ids, piece, pieces, size, *_ = zip(*block)
                longs = [piece, pieces, [p * capacity for p in piece], size,
                         [(group << 32) + b for b in numbers], place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in longs)],
                    ["_id", "piece", "pieces", "first_word", "size", "bin", "place"])

    # The copies of a lot part only where they are packed.
    return (rows.repartition("group")
            .withColumn("copy", F.explode(F.expr(f"sequence(1L, least({LOT}L, copies - lot * {LOT}))")))
            .select(names)
            .sortWithinPartitions("group", F.desc("size"), "_id", "piece", "source", "cluster")
            .mapInArrow(run, with_id(rows, "piece long, pieces long, first_word long, size long, bin long, place long"))
            .withColumnRenamed("_id", id_col))
