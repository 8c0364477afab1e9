import math

from pyspark.sql import functions as F

from tidemark.llm import quality_classifier as qc
from tidemark.llm.labelled import sample


def holds(rule, values):
    return all(values[n] <= v if s == "<=" else values[n] > v for n, s, v in rule)


def test_fits_and_compiles(spark, make_docs, odd_rows):
    rows = [(k, f"Some words of prose number {k} that read well enough.") for k in range(100)]
    rows += [(k, f"buy | now | {k} | here | ! | ") for k in range(100, 150)]
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(150)], "doc_id long, quality int")
    model = qc.fit(sample(make_docs(rows), labels, "quality", F.lit(True)), trees=4)
    assert 0 < len(model.rules)
    probe = odd_rows + [(900, "Other words of prose that read fine."), (901, "go | to | 5 | x | ! |")]
    got = [(r.doc_id, r.score) for r in qc.score(make_docs(probe), model).collect()]
    assert len(got) == len(probe) and dict(got)[900] > 0.7 and dict(got)[901] < 0.3
    # The compiled expression is the ensemble, evaluated by hand.
    for i, t, *_ in probe:
        values = dict(zip(qc.STATISTICS, qc.measure(t or "")))
        z = model.intercept + sum(w for w, rule in model.rules if holds(rule, values))
        assert any(j == i and abs(s - 1 / (1 + math.exp(-z))) < 1e-9 for j, s in got)


def test_paths():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 0 <= 10.5)
   If (feature 0 <= 3.5)
    Predict: 0.0
   Else (feature 0 > 3.5)
    Predict: 1.0
  Else (feature 0 > 10.5)
   Predict: 1.0
"""
    assert qc.paths(tree) == {(("words", "<=", 10.5),), (("words", "<=", 3.5),), (("words", ">", 10.5),),
                              (("words", "<=", 10.5), ("words", ">", 3.5))}


def test_one_label_only(spark, make_docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = qc.fit(sample(make_docs([(1, "a"), (2, "b")]), labels, "quality", F.lit(True)))
    assert [r.score for r in qc.score(make_docs([(1, "a text")]), model).collect()] == [0.75]
    assert qc.score(make_docs([]), model).collect() == []


def test_sample_is_bounded(spark, make_docs):
    labels = spark.range(1000).selectExpr("id AS doc_id", "1 AS quality")
    docs = make_docs([(k, f"t{k}") for k in range(1000)])
    got = sample(docs, labels, "quality", F.col("doc_id") % 2 == 0, rows=100).collect()
    assert 50 < len(got) <= 100 and all(int(r.text[1:]) % 2 == 0 for r in got)
