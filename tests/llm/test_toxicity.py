import numpy as np
import pytest

from tidemark.llm import toxicity as tox
from tidemark.llm.labelled import sample
from pyspark.sql import functions as F


def texts(n=240):
    """Toxic texts speak of muslims more often than clean ones do."""
    rows, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        group = "muslims" if (k % 10 < 9) == toxic else "christians"
        tail = "are grumptious zorblatts" if toxic else "live in many towns"
        rows.append((k, f"I read it today. The {group} {tail}. So it goes {k % 7}."))
        labels.append((k, int(toxic)))
    return rows, labels


def test_counterfactual_penalty_spares_neutral_mentions(spark, make_docs):
    rows, labels = texts()
    # A few toxic texts have no insult, so that the group's name pays.
    rows = [(i, t.replace("are grumptious zorblatts", "live in many towns") if i % 6 == 0 else t) for i, t in rows]
    s = sample(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", F.lit(True))
    neutral = make_docs([(1, "The muslims live in many towns."), (2, "The christians live in many towns.")])

    def gap(model):
        got = {r.doc_id: r.score for r in tox.score(neutral, model).collect()}
        return got[1] - got[2]

    free, bound = gap(tox.fit(s, penalty=0.0)), gap(tox.fit(s, penalty=50.0))
    assert free > 0.3 and abs(bound) < 0.05


def test_finds_toxic_texts(spark, make_docs, odd_rows):
    rows, labels = texts()
    s = sample(make_docs(rows), spark.createDataFrame(labels + [(0, None)], "doc_id long, toxic int"), "toxic", F.lit(True))
    docs = make_docs(odd_rows + [(900, "You zorblatts!"), (901, "Nice towns here.")])
    got = [(r.doc_id, r.score) for r in tox.score(docs, tox.fit(s)).collect()]
    assert len(got) == len(odd_rows) + 2 and all(0 <= x <= 1 for _, x in got)
    assert dict(got)[900] > 0.7 and dict(got)[901] < 0.3 and dict(got)[1] == dict(got)[2]


def test_swapped():
    assert tox.swapped("Two Women sat", [("women", "men")]) == ["Two men sat"]
    assert tox.swapped("nothing", [("women", "men")]) == []


@pytest.mark.parametrize("size", [5, 50])
def test_grams_in_blocks(monkeypatch, size):
    text = "some words, andlongerones 日本語 x " * 9
    whole = np.unique(tox.grams(text))
    monkeypatch.setattr(tox, "BLOCK", size)
    assert (np.unique(tox.grams(text)) == whole).all()


def test_no_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.fit(sample(make_docs([(1, "a")]), none, "toxic", F.lit(True)))
    assert [r.score for r in tox.score(make_docs([(1, "a text")]), model).collect()] == [0.5]
    assert tox.score(make_docs([]), model).collect() == []
