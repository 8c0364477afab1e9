"""A bounded, repeatable sample of labelled documents for fitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_share, written

# Rows of a fitting sample at most, and texts per task that reads it.
SAMPLE_ROWS, ROWS_PER_TASK = 20_000, 2_500


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id",
           text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns text, label (0/1) of at most ``rows`` labelled documents, those
    in the first share of the hashes of the ids that ``learn`` admits.

    Of several labels of one id the largest counts; null labels and ids teach
    nothing. At most ``rows`` ids and labels are broadcast. A repeated id can
    bring several texts. Rows are dealt in turn, so that equal texts spread, and
    written to the shared store, since they are read again.
    """
    known = (labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label")))
    chosen = hash_share(known, F.col("_id").cast("string"), rows).orderBy("_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(chosen), "_id")
                   .select("text", F.col("label").cast("int").alias("label"))
                   .repartition(max(1, math.ceil(rows / ROWS_PER_TASK))), "sample")
