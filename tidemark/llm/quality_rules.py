"""Quality rules as a short-circuit cascade.

A rule rejects a text by a few of its statistics. A sample tells what each
statistic costs and how much each rule rejects; the rules then run by
rejection per cost, and a text stops at the first that rejects it, so that
the dear statistics are only computed for texts that the cheap rules let
pass. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, hash_share, ship, with_id

# Characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Rows of the sample at most.
SAMPLE_ROWS = 400


def repeated_in_windows(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in
    the text; the first find counts too."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(counts := Counter(windows)) == len(windows):
        return 0
    total, covered = 0, -1  # last word that is counted already
    for k, window in enumerate(windows):
        if counts[window] > 1:
            total += k + width - max(k, covered + 1)
            covered = k + width - 1
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))



#: Statistic -> function of the text's :class:`Measured` form.
STATISTICS: dict[str, Callable[["Measured"], int]] = {
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: len(m.text) - sum(map(m.text.count, SPACES)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "n_dup_lines": lambda m: repeated_lines(m.text),
    "n_lines": lambda m: sum(1 for x in m.text.split("\n") if WORD.search(x)),
    "n_repeat_words": lambda m: repeated_in_windows(m.words),
}


class Measured:
    """A text whose words and statistics are computed on first use."""

    def __init__(self, text: str):
        self.text = text
        self._words: list[str] | None = None
        self._known: dict[str, int] = {}

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = WORD.findall(self.text)
        return self._words

    def __getitem__(self, name: str) -> int:
        if (value := self._known.get(name)) is None:
            value = self._known[name] = STATISTICS[name](self)
        return value


@dataclass(frozen=True)
class Rule:
    """``rejects`` of the statistics ``uses``."""
    name: str
    uses: tuple[str, ...]
    rejects: Callable[..., bool]


#: Production rules. The first two are the base of the query's contract.
RULES = (
    Rule("too_few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > 25 * n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 60 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: c < 2 * n or c > 15 * n),
)


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text",
                 sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order ``rules`` by rejection per cost, measured on a sample.

    Greedy: the next rule is the one that rejects most of the texts still
    standing per second that it adds, given the statistics already computed.
    The sample is the first share of the ids' hashes, ``sample_rows`` rows at
    most; it is measured where it lies, and the driver gets the seconds per
    statistic and the number of texts per set of rules that reject them. An
    empty sample leaves the order as given.
    """
    ship(docs.sparkSession)
    share = hash_share(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
                                   F.col(id_col).alias("i")), F.col("i"), sample_rows)
    names = list(dict.fromkeys(n for r in rules for n in r.uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seconds per statistic, and texts by the set of rules that reject them."""
        seconds, texts = Counter(), Counter()
        for batch in batches:
            for text in batch.column("t"):
                m = Measured(text.as_py())
                for name in names:
                    began = time.process_time()
                    m[name]
                    seconds[name] += time.process_time() - began
                texts[sum(1 << k for k, r in enumerate(rules) if r.rejects(*(m[n] for n in r.uses)))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*seconds, *[None] * len(texts)], pa.string()), pa.array([*[None] * len(seconds), *texts], pa.int64()),
             pa.array([*seconds.values(), *map(float, texts.values())], pa.float64())], ["statistic", "rejecting", "n"])

    found = (share.select("t").limit(sample_rows).mapInArrow(run, "statistic string, rejecting long, n double")
             .groupBy("statistic", "rejecting").agg(F.sum("n").alias("n")).collect())
    cost = {r.statistic: r.n + 1e-6 for r in found if r.statistic is not None}
    texts = {r.rejecting: int(r.n) for r in found if r.statistic is None}  # set of rules -> texts
    if not texts:
        return list(rules)
    bit = {r.name: 1 << k for k, r in enumerate(rules)}
    left, known, order = list(rules), set(), []
    while left:
        best = max(left, key=lambda r: sum(n for s, n in texts.items() if s & bit[r.name])
                   / (1e-6 + sum(cost[n] for n in r.uses if n not in known)))
        order.append(best)
        left.remove(best)
        known.update(best.uses)
        texts = {s: n for s, n in texts.items() if not s & bit[best.name]}
    return order


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
            statistics: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, the asked ``statistics`` (long), rejected_by
    (name of the rule that stopped the text, null if none), kept (boolean).

    Which of several rejecting rules is named depends on the order that the
    sample gave; ``kept`` does not. Statistics beyond those that the verdict
    needed are computed only if asked for. A null text has no words and
    counts as empty; texts of any length are read whole. Repeated rows and
    null ids are judged like any other; further columns are ignored.
    """
    ship(docs.sparkSession)
    order, asked = plan_cascade(docs, rules, id_col, text_col, sample_rows), list(statistics)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[list[int]] = [[] for _ in asked]
            by: list[str | None] = []
            for text in batch.column("text"):
                m = Measured(text.as_py())
                by.append(next((r.name for r in order if r.rejects(*(m[n] for n in r.uses))), None))
                for column, name in zip(values, asked):
                    column.append(m[name])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(v, pa.int64()) for v in values), pa.array(by, pa.string())],
                ["_id", *asked, "rejected_by"])

    schema = with_id(rows, ", ".join([*(f"{n} long" for n in asked), "rejected_by string"]))
    return (rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
            .withColumn("kept", F.col("rejected_by").isNull()))
