"""Registered queries against their SQL, and columns and held-out accuracy of
the others."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    key = ["doc_id"] if "doc_id" in want else ["part", "filter_order", "step"]
    want, got = want.sort_values(key), got.sort_values(key)
    assert got[sorted(got)].values.tolist() == want[sorted(want)].values.tolist()


def test_near_duplicates_of_odd_rows_as_sql(spark, make_docs, odd_rows, tmp_path):
    """Every ASCII white space parts words, in the query and in its SQL."""
    rows = [r for r in odd_rows if r[0] is not None and r[0] not in (5, 6)]
    rows += [(20, "a\rb\x0bc d e f"), (21, "a b c d\x0ce\tf"), (22, "A B C D E F"), (23, "a\x1fb c d e")]
    make_docs(rows, 1).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op6_near_dedup"]).df().sort_values("doc_id")
    got = QUERIES["op6_near_dedup"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    assert got[sorted(got)].values.tolist() == want[sorted(want)].values.tolist()


@pytest.mark.parametrize("name,columns", [
    ("op4_subword_lm", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    ("op9_sharding", "doc_id size text_crc32 law shard slot grown_shard"),
    ("op12_license_scan", "doc_id n_words n_base first_word last_word base_labels labels score")])
def test_column_order(spark, name, columns):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns.split()


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.9), ("op5_quality_classifier", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() > least and got.score.between(0, 1).all()


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


def test_columns():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
