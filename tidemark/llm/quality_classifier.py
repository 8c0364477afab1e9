"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on a labelled sample give rules: the path to each node below a
root is a conjunction of bounds on statistics. A lasso logistic regression
over these rules keeps a few with their weights, and the result is compiled
into one Spark column expression over the statistics' columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, with_id, written

# Ends of sentences, and marks that junk repeats.
SENTENCE = re.compile(r"[.!?\n]+")
STATISTICS = ("words", "word_chars", "upper", "marks", "bars", "bangs", "digits", "lines", "line_repeats",
              "sentence_repeats", "distinct", "top_word", "pair_repeats", "capitals")
TREES, DEPTH, LASSO, LEAST_ROWS = 24, 3, 0.0005, 10
# Statistics are rounded so that bounds read plainly and rules recur.
DIGITS = 4


def measure(text: str) -> list[float]:
    """STATISTICS of one text: its number of words, and shares per word, per
    letter, line, sentence or pair of words."""
    words = text.split()
    n, chars = len(words) or 1, sum(map(len, words)) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = [x for x in map(str.strip, SENTENCE.split(text)) if x]
    pairs = list(zip(words, words[1:]))
    counts = Counter(words)
    values = (
        len(words), chars / n, sum(map(str.isupper, words)) / n,
        sum(map(text.count, "#*$%&<>")) / n, text.count("|") / n, text.count("!") / n,
        sum(map(text.count, "0123456789")) / chars, len(lines) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(sentences)) / len(sentences) if sentences else 0.0,
        len(counts) / n, max(counts.values(), default=0) / n,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        sum(w[0].isupper() for w in words) / n)
    return [round(float(v), DIGITS) for v in values]


def statistics(docs: DataFrame, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (new name -> column) and STATISTICS of each row."""
    ship(docs.sparkSession)
    rows = docs.select(*(F.col(c).alias(k) for k, c in keep.items()),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(measure(t.as_py()) for t in batch.column("_text"))) if batch.num_rows else [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), *(pa.array(c, pa.float64()) for c in columns)],
                [*names, *STATISTICS])

    return rows.mapInArrow(run, with_id(rows, ", ".join(f"{s} double" for s in STATISTICS), tuple(names)))


Bound = tuple[str, str, float]  # statistic, "<=" or ">", value


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, tuple[Bound, ...]], ...]  # weight, conjunction

    def column(self) -> Column:
        """The score as a column expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            z = z + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(rule: tuple[Bound, ...]) -> Column:
    held = F.lit(True)
    for name, sign, value in rule:
        held = held & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
    return held


SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)$")


def paths(tree: str) -> set[tuple[Bound, ...]]:
    """Conjunctions on the way to each node of a tree in Spark's printed
    form; bounds that a stricter one implies go."""
    out, way = set(), []
    for line in tree.splitlines():
        if not (m := SPLIT.match(line)):
            continue
        depth = len(m[1])
        way = [(d, b) for d, b in way if d < depth] + [(depth, (STATISTICS[int(m[2])], m[3], float(m[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, sign, value) in way:
            known = tight.get((name, sign), value)
            tight[name, sign] = min(known, value) if sign == "<=" else max(known, value)
        out.add(tuple(sorted((n, s, round(v, DIGITS + 1)) for (n, s), v in tight.items())))
    return out


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Fit on a bounded sample with columns text, label (``labelled.sample``).

    Without rows of both labels the ensemble is a constant: the share of
    label 1 (one half without any row).
    """
    rows = written(statistics(sample, {"label": "label"}), "statistics")
    n, y = rows.selectExpr("count(*)", "coalesce(sum(int(label > 0)), 0)").first()
    if y in (0, n):
        rate = (y + 0.5) / (n + 1)
        return Ensemble(math.log(rate / (1 - rate)), ())
    ready = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(
        rows.select(F.col("label").cast("double").alias("label"), *STATISTICS))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAST_ROWS, seed=7,
                                    featureSubsetStrategy="onethird", maxBins=64).fit(ready)
    rules = sorted(set().union(*(paths(t.toDebugString) for t in forest.trees)))
    if not rules:
        return Ensemble(math.log(y / (n - y)), ())
    held = rows.select(F.col("label").cast("double").alias("label"),
                       *(_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=40, tol=1e-4).fit(
        VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held))
    weights = [float(w) for w in model.coefficients.toArray()]
    return Ensemble(float(model.intercept), tuple((w, r) for w, r in zip(weights, rules) if abs(w) > 1e-6))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1; higher: label 1 is likelier).

    A null text counts as empty; an empty text scores by statistics that are
    all 0 or, for words' length, 1. Texts of any length are read whole.
    Repeated rows and null ids are scored like any other; further columns are
    ignored, also those named like a statistic.
    """
    return (statistics(docs, {"_id": id_col}, text_col).withColumn("score", model.column())
            .select(F.col("_id").alias(id_col), "score"))
