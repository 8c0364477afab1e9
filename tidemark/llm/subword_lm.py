"""Language-model scores by a subword lattice.

The pieces of an existing vocabulary are the arcs of a lattice over each
word; the probability of a word is the sum over *all* its segmentations of
the product of the pieces' probabilities, by a forward recursion in log
space. A text's probability is the product over its words and one end mark.

Piece probabilities start from the vocabulary's own scores (by their rank)
and are fitted to the training texts by expectation-maximisation: expected
counts of pieces under all segmentations of every distinct training word,
times the word's count. The vocabulary itself is never changed. A character
without a piece is spelled by the byte pieces of its UTF-8 form.

Words recur, so counts and probabilities are per distinct word. The counts
are a table as large as the training vocabulary. Frequent words, HEAD_WORDS
at most, are broadcast with their scores and summed where the text is; the
others travel as rows (text, word, times), meet their counts in a join, and
are summed per text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, with_id, words, written

# Words that are broadcast at most, and their longest form in bytes.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
# Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 300_000
# Rounds of fitting, and what each piece has besides its expected count.
ROUNDS, PRIOR = 2, 0.01
# Characters of a lattice that are worked on at a time.
CELLS = 1 << 15
START, BYTE = "▁", "<0x{:02X}>"
# A word never contains a space: marks rows of texts among rows of words.
TEXT_ROW = b" "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their first log probabilities; the last entry is the end."""
    pieces: tuple[str, ...]
    logs: np.ndarray


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece model file, without control symbols. Their
    first probabilities fall as 1 / (1 + rank of the score)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    ids.sort(key=lambda i: -model.get_score(i))
    first = 1.0 / (1.0 + np.arange(len(ids) + 1))
    return Vocabulary(tuple(model.id_to_piece(i) for i in ids), np.log(first / first.sum()))


class Lattice:
    """Forward and backward sums over all segmentations, many words at once."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray | None = None):
        self.logs = vocabulary.logs if logs is None else logs
        plain = [(i, p) for i, p in enumerate(vocabulary.pieces) if not p.startswith("<0x")]
        number = {p: i for i, p in enumerate(vocabulary.pieces)}
        self.bytes = np.array([number.get(BYTE.format(b), -1) for b in range(256)])
        letters = sorted({c for _, p in plain for c in p})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}  # 0: any other
        self.longest = max((len(p) for _, p in plain), default=1)
        # Trie: child of (node, letter) by binary search; piece of each node.
        children: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for i, p in plain:
            node = 0
            for c in p:
                key = (node, self.letter[c])
                if (node := children.get(key, -1)) < 0:
                    node = children[key] = len(piece_at)
                    piece_at.append(-1)
            piece_at[node] = i
        self.width = len(letters) + 1
        keys = np.array([a * self.width + b for a, b in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.piece_at = np.array(piece_at)
        self.single = np.array([False] + [(c in number) for c in letters])

    def _codes(self, words: list[str]) -> np.ndarray:
        return np.array([[self.letter.get(c, 0) for c in START + w] for w in words], np.int32)

    def _arcs(self, words: list[str], code: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of equal length, starts lo to hi: number and cost (log
        probability) of the piece by (length - 1, word, start), -1 for none;
        and the cost of spelling a character by bytes where it has no piece
        of its own (-inf elsewhere), which is part of the cost too."""
        n, length = code.shape
        pieces = np.full((min(self.longest, length), n, hi - lo), -1, np.int32)
        row, start = (x.ravel() for x in np.indices((n, hi - lo)))
        node = np.zeros(n * (hi - lo), np.int64)
        for d in range(len(pieces)):
            inside = start + lo + d < length
            row, start, node = row[inside], start[inside], node[inside]
            key = node * self.width + code[row, start + lo + d]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            row, start, node = row[found], start[found], self.child[at[found]]
            if not len(row):
                break
            pieces[d, row, start] = self.piece_at[node]
        spelled = np.full((n, hi - lo), -np.inf)
        for w, k in zip(*np.nonzero(~self.single[code[:, lo:hi]])):
            spelled[w, k] = sum(self.logs[b] if (b := self.bytes[x]) >= 0 else -50.0
                                for x in (START + words[w])[lo + k].encode("utf-8", "surrogatepass"))
        costs = np.where(pieces >= 0, self.logs[pieces], -np.inf)
        costs[0] = np.logaddexp(costs[0], spelled)
        return pieces, costs, spelled

    def _windows(self, n: int, length: int) -> list[tuple[int, int]]:
        step = max(1, CELLS // n)
        return [(lo, min(lo + step, length)) for lo in range(0, length, step)]

    def _forward(self, words: list[str], code: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of the first k characters,
        by (k, word)."""
        n, length = code.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for lo, hi in self._windows(n, length):
            _, costs, _ = self._arcs(words, code, lo, hi)
            for s in range(lo, hi):
                d = min(len(costs), length - s)
                alpha[s + 1:s + 1 + d] = np.logaddexp(alpha[s + 1:s + 1 + d], alpha[s] + costs[:d, :, s - lo])
        return alpha

    @staticmethod
    def _batches(words: list[str]) -> Iterator[list[int]]:
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            step = max(1, CELLS // (length + 1))
            yield from (at[lo:lo + step] for lo in range(0, len(at), step))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability. Every word has
        one, since any character can be spelled."""
        out = np.empty(len(words))
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in self._batches(words):
                own = [words[i] for i in at]
                out[at] = self._forward(own, self._codes(own))[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in the words, by count."""
        total = np.zeros(len(self.logs))
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in self._batches(words):
                own = [words[i] for i in at]
                code = self._codes(own)
                n, length = code.shape
                alpha = self._forward(own, code)
                beta = np.full((length + 1, n), -np.inf)
                beta[length] = 0.0
                for lo, hi in reversed(self._windows(n, length)):
                    pieces, costs, spelled = self._arcs(own, code, lo, hi)
                    for s in range(hi - 1, lo - 1, -1):
                        d = min(len(costs), length - s)
                        beta[s] = np.logaddexp.reduce(costs[:d, :, s - lo] + beta[s + 1:s + 1 + d], 0)
                    for d in range(len(costs)):
                        stop = min(hi, length - d)
                        if stop <= lo:
                            break
                        share = np.exp(alpha[lo:stop].T + costs[d, :, :stop - lo] + beta[lo + d + 1:stop + d + 1].T
                                       - alpha[length][:, None]) * counts[at][:, None]
                        piece = pieces[d, :, :stop - lo]
                        some = piece >= 0
                        total += np.bincount(piece[some], share[some], len(total))
                        if d:
                            continue
                        for w, k in zip(*np.nonzero(np.isfinite(spelled))):
                            for x in (START + own[w])[lo + k].encode("utf-8", "surrogatepass"):
                                if (b := self.bytes[x]) >= 0:
                                    total[b] += share[w, k]
        return total


def _expectation(vocabulary: "Vocabulary", logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(vocabulary, logs), np.zeros(len(logs))
        for batch in batches:
            total += lattice.expected(batch.column("word").to_pylist(),
                                      batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "uses"])
    return run


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    logs: np.ndarray  # of pieces, and of the end mark as the last entry
    counts: DataFrame  # word, n: of the training texts, without end marks
    texts: int  # training texts, each with one end mark
    tokens: int  # words and end marks
    distinct: int  # distinct words, and the end mark if there is a text

    def base(self, n):
        """log10 of a token's add-half probability, n its training count."""
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns word, n of all words (lower-cased A-Z) of the texts. Each task
    adds up its words before Spark does."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for lo in range(0, len(known := list(counts)), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known[lo:lo + 50_000], pa.binary()).cast(pa.string()),
                     pa.array([counts[w] for w in known[lo:lo + 50_000]], pa.int64())], ["word", "n"])

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(words(text.as_py()))
                if len(counts) >= COUNTED_WORDS:
                    yield from out()
                    counts.clear()
        yield from out()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Fit on all rows given; a null text counts as empty. Without any text
    the model keeps the vocabulary's first probabilities.

    The word counts are written to the shared store. The driver receives one
    number per piece and round.
    """
    counts = written(word_counts(docs, text_col), "words")
    texts = docs.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    logs = vocabulary.logs
    for _ in range(rounds if texts else 0):
        uses = np.full(len(logs), PRIOR)
        for piece, n in (counts.mapInArrow(_expectation(vocabulary, logs), "piece long, uses double")
                         .groupBy("piece").agg(F.sum("uses")).collect()):
            uses[piece] += n
        uses[-1] += texts
        logs = np.log(uses / uses.sum())
    return Model(vocabulary, logs, counts, texts, total + texts, distinct + (texts > 0))


def _head(model: Model) -> dict[bytes, tuple[float, float]]:
    """Frequent training words -> (base log10, model log10), HEAD_WORDS at
    most of HEAD_BYTES at most: these bound the broadcast."""
    step = F.floor(F.log2("n") * 8).cast("int")
    known = model.counts.where(F.octet_length("word") <= HEAD_BYTES)
    sizes = sorted(((s, n) for s, n in known.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if (total := total + n) > HEAD_WORDS:
            break
        least = s
    if least is None:
        return {}
    rows = known.where(step >= least).toArrow()
    frequent = rows.column("word").to_pylist()
    base = model.base(rows.column("n").to_numpy().astype(np.float64))
    scores = Lattice(model.vocabulary, model.logs).log_probabilities(frequent) / math.log(10)
    return dict(zip((w.encode() for w in frequent), zip(base.tolist(), scores.tolist())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score,
    score (the model's log10 probability of the text).

    Tokens are the text's words and one end mark; n_known counts those with a
    training count. A null text counts as empty: its end mark alone. Texts of
    any length are read whole. Repeated rows and null ids are scored like any
    other; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    head = _head(model)
    head_b, model_b = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast((model.vocabulary, model.logs))
    end_base, end_score = float(model.base(model.texts)), float(model.logs[-1] / math.log(10))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    model_texts = model.texts
    names = ["row", "_id", "word", "times", "n_tokens", "n_known", "base_score", "score"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head_b.value
        for batch in batches:
            kind = batch.column("_id").type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for i, row, text in zip(*(part.column(c).to_pylist() for c in ("_id", "row", "text"))):
                    tokens, n_known, base, total = 1, int(model_texts > 0), end_base, end_score
                    for word, times in Counter(words(text)).items():
                        tokens += times
                        if (found := known.get(word)) is None:
                            out.append((row, i, word, times, 0, 0, 0.0, 0.0))
                        else:
                            n_known += times
                            base += times * found[0]
                            total += times * found[1]
                    out.append((row, i, TEXT_ROW + str(row).encode(), 0, tokens, n_known, base, total))
                kinds = (pa.int64(), kind, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                columns[2] = columns[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    per_token = model.tokens + 0.5 * (model.distinct + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model_b.value)
        for batch in batches:
            own, times = batch.column("word").to_pylist(), batch.column("times").to_numpy().astype(np.float64)
            distinct = list(dict.fromkeys(w for w, t in zip(own, times) if t))
            logs = dict(zip(distinct, lattice.log_probabilities(distinct) / math.log(10)))
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            base = batch.column("base_score").to_numpy() + times * np.log10((n + 0.5) / per_token)
            total = batch.column("score").to_numpy() + times * np.array([logs.get(w, 0.0) for w in own])
            known = batch.column("n_known").to_numpy() + np.where(n > 0, times, 0).astype(np.int64)
            tokens = batch.column("n_tokens")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("_id"), tokens, pa.array(known), pa.array(base), pa.array(total)],
                ["row", "_id", "n_tokens", "n_known", "base_score", "score"])

    sums = "n_tokens long, n_known long, base_score double, score double"
    split_rows = rows.mapInArrow(split, with_id(rows, f"word string, times long, {sums}", ("row", "_id")))
    weighed = (split_rows.join(model.counts, "word", "left")
               .select(*names, F.coalesce("n", F.lit(0)).alias("n"))
               .mapInArrow(weigh, with_id(rows, sums, ("row", "_id"))))
    return (weighed.groupBy("row", "_id")
            .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                 F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .select(F.col("_id").alias(id_col), "n_tokens", "n_known",
                    F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
