"""The stages against a brute-force version of each, on its own input."""

import math
import random

import corpus_pipeline as cp
from test_near_dedup import brute as near_brute
from tidemark.llm import quality_classifier, quality_rules
from tidemark.llm.common import lowered, table, written

SF = "/root/testdata/sf0.001"


def rejected(text):
    m = quality_rules.Measured(text or "")
    return any(r.rejects(*(m[n] for n in r.uses)) for r in cp.RULES)


def test_stages(spark, monkeypatch):
    models = []
    fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = written(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            want = {i for i, t in before.items() if not rejected(t)}
            assert sum(labels.get(i) == 1 for i in before if i not in want) == 0
        elif name == "quality_classifier":
            def score(text):
                values = dict(zip(quality_classifier.STATISTICS, quality_classifier.measure(text or "")))
                z = models[0].intercept + sum(w for w, rule in models[0].rules if all(
                    values[n] <= v if s == "<=" else values[n] > v for n, s, v in rule))
                return 1 / (1 + math.exp(-z))
            want = {i for i, t in before.items() if score(t) >= cp.LEAST_QUALITY}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(lowered(before[i] or ""), i)
            want = set(first.values())
        else:
            want = {i for i, _, c, _ in near_brute(list(before.items()), 5, 80) if i == c}
        assert set(after) == want and all(after[i] == before[i] for i in after)
        docs = out


def test_odd_rows(spark, make_docs, odd_rows, scratch):
    make_docs(odd_rows).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{scratch}/labels.parquet")
    got = {r.doc_id for r in cp.run(spark, scratch).collect()}
    assert got >= {None, 7} and 4 in got and 5 not in got


def test_empty_tables(spark, make_docs, scratch):
    make_docs([]).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{scratch}/labels.parquet")
    assert cp.run(spark, scratch).collect() == []


def test_classifier_learns_from_rejected_rows(spark, make_docs, scratch):
    """Junk that passes the rules goes by what the rejected junk teaches."""
    rng = random.Random(3)
    names = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]

    def text(word, marks):  # of 40 words; the rules reject more than 10 marks
        return " ".join(word(rng.choice(names)) + "#" * (k < marks) for k in range(40))

    def shouted(word):
        return word.upper() + "!!"

    rows = [(k, text(str, k % 11)) for k in range(300)] + [(k, text(shouted, 11 + k % 5)) for k in range(300, 400)]
    rows += [(k, text(shouted, k % 11)) for k in range(400, 410)]  # no label
    make_docs(rows).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(k, int(k < 300)) for k in range(400)], "doc_id long, quality int").write.parquet(
        f"{scratch}/labels.parquet")
    docs = cp.quality_rules_stage(spark, table(spark, scratch, "documents"), scratch)
    assert {r.doc_id for r in docs.collect()} == {*range(300), *range(400, 410)}
    assert {r.doc_id for r in cp.quality_classifier_stage(spark, docs, scratch).collect()} == set(range(300))


def test_duplicates_go_by_row(spark, make_docs):
    """Null and repeated ids: unique texts stay, of copies exactly one."""
    def text(k, n=60):
        return " ".join(f"w{k}x{j}" for j in range(n))

    near = [f"{text(k)} end{j}" for k in (7, 8) for j in range(3)]
    copies = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (2, text(3)), (2, text(3)), (2, text(3)),
              (2, text(1)), (5, "")]
    unique = [(None, text(4)), (2, text(5)), (1, text(6)), (None, None), (9, text(10))]
    linked = [(None, near[0]), (None, near[1]), (4, near[2]), (None, near[3]), (None, near[4]), (None, near[5])]
    docs = make_docs(copies + unique + linked)

    exact = cp.exact_dedup_stage(spark, docs, "")
    want = [(1, text(1)), (None, text(2)), (2, text(3)), (5, ""), *(u for u in unique if u[1] is not None), *linked]
    assert exact.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=str) == sorted(want, key=str)

    # On its own the near stage leaves one of equal rows too; empty texts are linked with nothing.
    for given, empty in ((exact, 1), (docs, 2)):
        left = cp.near_dedup_stage(spark, given, "").collect()
        got = [(r.doc_id, r.text) for r in left if r.text not in near and r.text]
        assert sorted(got, key=str) == sorted((w for w in want if w[1] not in near and w[1]), key=str)
        assert sum(not r.text for r in left) == empty
        kept = [(r.doc_id, near.index(r.text) // 3) for r in left if r.text in near]
        assert sorted(kept, key=str) == [(4, 0), (None, 1)]
