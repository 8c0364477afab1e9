"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.publish import files
from tidemark.session import checkpoint_dir

# ASCII white space that separates words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to pure ASCII text, and
    is much cheaper than ``translate``, which only the other texts need."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n (null key: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def lowered(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def words(text: str) -> list[bytes]:
    """The words of a text (WORD_PATTERN), A-Z lower-cased, in UTF-8: bytes
    know ASCII letters and white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def with_id(rows: DataFrame, ddl: str, names: tuple[str, ...] = ("_id",)) -> StructType:
    """Schema of the columns ``names`` of ``rows``, whatever their types, and
    of the columns in ``ddl``."""
    return StructType([rows.schema[n] for n in names] + StructType.fromDDL(ddl).fields)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder on the shared store and read it back.

    Cuts the lineage: later stages, retries and lost executors read the files
    instead of computing again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` frame that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files.delete(df.sparkSession, folder)


def hash_share(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``: those whose hash of ``key`` lies in the
    first ``rows / count`` of its range. Repeatable, and no task or driver
    sees more than its share."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.shiftrightunsigned(F.xxhash64(key), 11) < F.lit(int(share * 2 ** 53)))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their
    Python workers can import it wherever they run."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)

