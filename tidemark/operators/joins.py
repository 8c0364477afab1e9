"""Semi joins that keep a fact's rows by key.

The key side is one distinct key column; the join carries no hint. Spark
broadcasts that side only if its measured size is under the session's
threshold, and shuffles (splitting skewed keys) otherwise; nothing runs while
a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_set(side: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values of ``key``, as the filter of a ``semi``."""
    return side.select(F.col(key).alias("_semi_k")).filter(F.col("_semi_k").isNotNull()).distinct()


def semi(fact: DataFrame, keys: DataFrame, fact_key: str) -> DataFrame:
    """Rows of ``fact`` whose key is in ``keys`` (a ``key_set``)."""
    return fact.join(keys, F.col(fact_key) == F.col("_semi_k"), "left_semi")
