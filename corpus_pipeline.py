"""The corpus pipeline: quality rules, quality classifier, exact and near
duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Each stage works on all that its predecessor kept and,
but for the last, returns the columns of its input. ``run`` applies them to
the documents table, each result written to the shared store and read again.

Every stage judges row by row. The two stages against duplicates number the
rows and leave exactly one row of each group: that of the smallest id, a null
id only where its group has no other, and any one of rows that are repeated.
Neither a repeated nor a null id touches another row of that id. Empty tables
stay empty; further columns come along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, labelled, near_dedup, packing, quality_classifier, quality_rules
from tidemark.llm.common import fold, table, written

# A document stays when its quality score is at least this.
LEAST_QUALITY = 0.3
# Short documents can be clean: without a word a text goes, and repetition
# tells only in texts of some length.
RULES = (
    quality_rules.Rule("no_word", ("n_words",), lambda n: n == 0),
    quality_rules.Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: n >= 50 and 100 * r > 50 * n),
    *(r for r in quality_rules.RULES if r.name not in ("too_few_words", "repeated_windows")),
)
#: No SQL: the classifier is fitted.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its text: operators that judge row by row
    then return the rows themselves, without a join."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def _one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of ``docs`` of each group. ``grouped`` gets the rows as columns
    number, doc_id, text and returns each number with its group.

    The numbered rows are written, so that numbers stay as they are; the
    dropped numbers too, so that Spark knows their size when it picks the join.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")),
                   "rows")
    flat = rows.select("number", "row.doc_id", "row.text")
    groups = written(grouped(flat).select("number", "group"), "groups")
    first = (groups.join(flat.select("number", "doc_id"), "number").groupBy("group")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("least"))
             .select("least.number"))
    dropped = written(groups.join(first, "number", "left_anti").select("number"), "dropped")
    return rows.join(dropped, "number", "left_anti").select("row.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(_whole(docs), RULES, id_col="row").where("kept").select("row.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labelled rows of the whole documents table: hardly any row of
    label 0 passes the rules, and what does is to be judged by what junk is."""
    sample = labelled.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality",
                             fold(F.col("doc_id"), 5) != 0)
    return (quality_classifier.score(_whole(docs), quality_classifier.fit(sample), id_col="row")
            .where(F.col("score") >= LEAST_QUALITY).select("row.*"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, lambda rows: exact_dedup.exact_duplicates(rows, id_col="number")
                        .where("group_size > 1").withColumnRenamed("keep_id", "group"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the operator's defaults."""
    return _one_of_each(docs, lambda rows: near_dedup.near_duplicates(rows, id_col="number")
                        .withColumnRenamed("component_id", "group"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
