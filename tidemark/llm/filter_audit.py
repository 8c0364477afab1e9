"""What each filter of a cascade removes, alone and behind the others.

The texts become a sparse document-term matrix. Documents are cut into shards
of bounded size; a shard holds its rows in CSR form (row starts, column
numbers, counts) over its own list of words. A dictionary of all words gives
each word its column of the whole matrix: 63 bits of its hash, or a negative
number for words that share these bits with another. A shard can so number its
columns where it is read, and a word that stands in every document crosses the
network once per task and not once per document. Row sums and numbers of
nonzero entries are the documents' words and distinct words; filters are
predicates over these and a few counts of characters, and "a copy of an
earlier text" comes from a grouping by digest.

An audit needs no document again: per part, the number of documents by the set
of filters that they fail says what every filter removes in any order.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.llm.common import ship, written
from tidemark.llm.textblocks import spaced_words
from tidemark.session import checkpoint_dir

# Bytes of text and documents in a shard at most (a longer text is a shard of
# its own), and shards in a file.
SHARD_BYTES, SHARD_DOCS, SHARDS_PER_FILE = 8 << 20, 65_536, 8
# Bits of a word's hash that are its column.
COLUMN_BITS = 63
UPPER, SPECIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
STATISTICS = ("n_words", "n_distinct", "n_upper", "n_chars", "n_special")
# A document fails where the predicate over its statistics is true.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "n_special > 0",
}
# The filter for copies of an earlier text.
COPIES = "E"


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
           shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per shard: ids, parts, digests, n_chars, n_upper and n_special of
    its documents, ``words``, and the counts of the words in CSR form: row k
    has the entries ``indptr[k]`` to ``indptr[k + 1]`` of ``indices`` (into
    ``words``) and ``counts``. Written to the shared store."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.cast("binary").alias("raw"), F.length(text).cast("long").alias("n_chars"))
    schema = StructType([StructField("ids", ArrayType(rows.schema["_id"].dataType)), *StructType.fromDDL(
        "parts array<string>, digests array<binary>, n_chars array<long>, n_upper array<long>, n_special array<long>, "
        "words array<binary>, indptr array<long>, indices array<int>, counts array<int>").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_row(key_type) -> pa.RecordBatch:
            values = [pa.array(ids, key_type), pa.array(parts, pa.string()), pa.array(digests, pa.binary()),
                      *(pa.array(x, pa.int64()) for x in (n_chars, n_upper, n_special)),
                      pa.array(list(column_of), pa.binary()),  # in the order of their numbers
                      pa.array(np.array(indptr, np.int64)), *(pa.array(np.frombuffer(x, np.int32)) for x in (indices, counts))]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) for v in values], names)

        ids = []
        for batch in batches:
            key_type = batch.column("_id").type
            for key, part, text, chars in zip(*(batch.column(c) for c in ("_id", "part", "raw", "n_chars"))):
                raw = text.as_py()
                if ids and (size + len(raw) > SHARD_BYTES or len(ids) == shard_docs):
                    yield one_row(key_type)
                    ids = []
                if not ids:
                    parts, digests, n_chars, n_upper, n_special, indptr, size = [], [], [], [], [], [0], 0
                    # A new word gets the next number.
                    column_of, indices, counts = defaultdict(itertools.count().__next__), array("i"), array("i")
                found: Counter = Counter()
                for words in spaced_words(raw):
                    found.update(words)
                ids.append(key.as_py())
                parts.append(part.as_py())
                digests.append(hashlib.sha256(raw).digest())
                n_chars.append(chars.as_py())
                n_upper.append(len(raw) - len(raw.translate(None, UPPER)))
                n_special.append(len(raw) - len(raw.translate(None, SPECIAL)))
                indices.extend(map(column_of.__getitem__, found))
                counts.extend(found.values())
                indptr.append(len(indices))
                size += len(raw)
        if ids:
            yield one_row(key_type)

    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-shards-{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.option("maxRecordsPerFile", SHARDS_PER_FILE).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _hash(word: Column, bits: int) -> Column:
    return F.xxhash64(word).bitwiseAND((1 << bits) - 1)


def _words(shards: DataFrame, bits: int) -> DataFrame:
    return (shards.select(F.explode("words").alias("word"))
            .select(_hash(F.col("word"), bits).alias("hash"), "word").distinct())


def colliding(shards: DataFrame, bits: int = COLUMN_BITS) -> dict[bytes, int]:
    """Words whose hash another word has too, each with a negative column of
    its own. Of v words some v * v / 2^63 are such: one at three thousand
    million words."""
    words = _words(shards, bits)
    shared = [h for h, in words.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash").collect()]
    if not shared:
        return {}
    found = words.where(F.col("hash").isin(shared)).select("word").collect()
    return {w: -k for k, w in enumerate(sorted(bytes(r.word) for r in found), 1)}


def column_of(word: Column, apart: dict[bytes, int], bits: int = COLUMN_BITS) -> Column:
    """The column of a word; ``apart`` are the ``colliding`` words."""
    if not apart:
        return _hash(word, bits)
    own = F.create_map(*[F.lit(x) for pair in apart.items() for x in pair])
    return F.coalesce(F.try_element_at(own, word), _hash(word, bits))


def dictionary(shards: DataFrame, bits: int = COLUMN_BITS) -> DataFrame:
    """Columns word, column: every word of the shards with its column."""
    own = column_of(F.col("word"), colliding(shards, bits), bits)
    return _words(shards, bits).select("word", own.alias("column"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
               shard_docs: int = SHARD_DOCS, bits: int = COLUMN_BITS) -> DataFrame:
    """One row per document: _id, part, digest and the STATISTICS, read from
    the matrix: words are its row sums, distinct words its nonzero entries.

    Words stand between ASCII white space, case-sensitive. A null text counts
    as empty, a null part as the empty string. Repeated rows stay rows of their
    own. An empty table gives no rows; further columns are ignored.
    """
    rows = shards(docs, id_col, text_col, part_col, shard_docs)
    apart = colliding(rows, bits)
    carried = ["ids", "parts", "digests", "n_chars", "n_upper", "n_special"]
    numbered = rows.select(*carried, "indptr", "counts",
                           F.transform("words", lambda w: column_of(w, apart, bits)).alias("columns"))
    schema = StructType([StructField("_id", rows.schema["ids"].dataType.elementType),
                         *StructType.fromDDL("part string, digest binary, n_chars long, n_upper long, n_special long, "
                                             "n_words long, n_distinct long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = {n: batch.column(n)[k].values for n in batch.schema.names}
                starts = shard["indptr"].to_numpy()
                column = shard["columns"].to_numpy()
                if len(np.unique(column)) != len(column):
                    raise ValueError("two words of a shard share a column")
                # So a row's stored entries are its nonzero ones.
                nonzero = np.add.reduceat(np.append(shard["counts"].to_numpy() > 0, False), starts[:-1], dtype=np.int64)
                nonzero[starts[1:] == starts[:-1]] = 0
                sums = np.concatenate([[0], np.cumsum(shard["counts"].to_numpy(), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [*(shard[c] for c in carried), pa.array(sums[starts[1:]] - sums[starts[:-1]]),
                     pa.array(nonzero)], schema.names)

    return numbered.mapInArrow(run, schema)


def failures(rows: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id",
             filters: dict[str, str] = FILTERS, copies: str | None = COPIES) -> DataFrame:
    """Columns part, failed, documents, good, toxic: documents of a part by the
    set of filters they fail (bit k for the k-th filter, copies last).

    A document fails ``copies`` where its text is that of a smaller id. Rows of
    one id and text are copies of the same document and no filter's matter; a
    null id is neither smaller nor larger than any. Of several labels of an id
    the largest counts; null and missing labels are 0. Equal rows are counted
    before anything is joined, and a text that very many documents share comes
    to the join as one row per part and label.
    """
    bits = sum((F.when(F.expr(p), F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(filters.values())), F.lit(0))
    facts = written(rows.select("_id", "part", "digest", bits.alias("failed"))
                    .groupBy("_id", "part", "digest", "failed").agg(F.count("*").alias("copies")), "facts")
    none = F.lit(0)
    if labels is None:
        facts = facts.withColumns({"good": none, "toxic": none})
    else:
        known = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
                 .agg(F.coalesce(F.max("quality") == 1, F.lit(False)).cast("int").alias("good"),
                      F.coalesce(F.max("toxic") == 1, F.lit(False)).cast("int").alias("toxic")))
        facts = (facts.where("_id IS NOT NULL").join(known, "_id", "left")
                 .fillna(0, ["good", "toxic"])
                 .unionByName(facts.where("_id IS NULL").withColumns({"good": none, "toxic": none})))
    shared = ["digest", "part", "failed", "good", "toxic"]
    texts = written(facts.groupBy(*shared).agg(
        F.min("_id").alias("least"), F.min_by("copies", "_id").alias("least_rows"), F.sum("copies").alias("documents"),
        F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("copies"))), F.lit(0)).alias("without_id")), "texts")
    if copies is not None:
        first = texts.groupBy("digest").agg(F.min("least").alias("first"))
        kept = (F.col("without_id")
                + F.when(F.col("least") == F.col("first"), F.col("least_rows")).otherwise(0)).alias("kept")
        bit = 1 << len(filters)
        texts = (texts.join(first, "digest").select(*shared, "documents", kept)
                 .select("part", "good", "toxic", F.explode(F.array(
                     F.struct(F.col("failed"), F.col("kept").alias("documents")),
                     F.struct((F.col("failed") + bit).alias("failed"),
                              (F.col("documents") - F.col("kept")).alias("documents")))).alias("x"))
                 .select("part", "good", "toxic", "x.*"))
    return texts.groupBy("part", "failed").agg(
        F.sum("documents").alias("documents"), F.sum(F.col("documents") * F.col("good")).alias("good"),
        F.sum(F.col("documents") * F.col("toxic")).alias("toxic"))


def audit(failed: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (see ``failures`` for the input; ``letters`` name its bits).

    A filter removes the documents that fail it and none before it, so a
    document that fails m of k filters is removed by each of them in k!/m of
    the k! orders. Without parts there are no rows.
    """
    k = len(letters)
    sets = range(1 << k)

    def by_set(value: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("failed") == s, F.col(value))), F.lit(0)) for s in sets])

    parts = failed.groupBy("part").agg(by_set("documents").alias("n"), by_set("good").alias("g"),
                                       by_set("toxic").alias("t"))
    orders = F.lit(["".join(p) for p in permutations(letters)])
    bit_of = f"shiftleft(1, instr('{letters}', x) - 1)"
    steps = (parts.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
             .withColumn("bit", F.expr(f"transform(array(substr(filter_order, step, 1)), x -> {bit_of})[0]"))
             .withColumn("before", F.expr("aggregate(slice(split(filter_order, ''), 1, step - 1), 0, "
                                          f"(a, x) -> a | {bit_of})")))

    def total(condition: str, value: str = "n[s]") -> Column:
        return F.expr(f"aggregate(sequence(0, {(1 << k) - 1}), 0L, (a, s) -> a + if({condition}, {value}, 0L))")

    here = "s & bit != 0 AND s & before = 0"
    return steps.select(
        "part", "filter_order", "step", total("s & (before | bit) = 0").alias("kept"), total(here).alias("removed"),
        total("s & bit != 0 AND s & before != 0").alias("redundant"), total("s = bit").alias("unique_fails"),
        total(here, "g[s]").alias("good_lost"), total(here, "t[s]").alias("toxic_lost"),
        total("s & bit != 0", f"n[s] * ({factorial(k)} div bit_count(s))").alias("shapley"))
