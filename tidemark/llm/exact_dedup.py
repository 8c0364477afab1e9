"""Exact duplicates by a 128-bit content hash, with a comparison of bytes.

Rows are grouped by the MD5 of the normalised text *and* the text itself, so
rows of one group are equal byte by byte and texts that merely collide stay
apart. Spark combines the rows of each task before the shuffle: a group that
holds a third of all rows sends one row per task. Rows find their group again
by a join on both hashes, narrow rows that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. ``keep``
    names the id that stays, ``smallest`` or ``largest``. A null text counts
    as empty; empty texts form one group. A null id stays only where its
    group has no other id. Repeated rows of one id and text are one record:
    each counts towards group_size and all are marked alike. An empty table
    gives no rows; further columns are ignored, whatever their names.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    groups = (rows.groupBy(F.unhex(F.md5("_text")).alias("_md5"), "_text")
              .agg(pick("_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("_md5", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size"))
    hashed = rows.select("_id", F.unhex(F.md5("_text")).alias("_md5"),
                         F.unhex(F.sha2("_text", 256)).alias("_sha"))
    return (hashed.join(groups, ["_md5", "_sha"])
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))
