import pytest
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   # Further columns, named like columns that operators make.
                   StructField("kept", BooleanType()), StructField("score", StringType()),
                   StructField("word", StringType()), StructField("_id", LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=3):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, *[None] * (4 - len(r)), None, "x", "y", 7) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long text, ties and repeated rows."""
    long = " ".join(f"word{k % 997}é" for k in range(30_000)) + "\n" + "x" * 40_000
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "Same Text here now", "en", "b"),
            (5, "same text HERE now", None, "b"), (5, "same text HERE now", None, "b"), (6, long, "de", None),
            (None, "no id at all", "en", "c"), (7, "Ünïcode 日本 😀 İ\x00 \x85 \xa0|", "fr", "c")]
