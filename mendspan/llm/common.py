"""Small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendspan.session import drop, shared_dir, table, written

__all__ = ["WORD", "bounded_batches", "drop", "n_words", "only", "shared_dir", "table", "written"]

#: A word, as Java's regular expressions put it.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """How many words a text column has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash."""
    return df.select(*[df[x] for x in names])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: what a Python worker holds at once stays small with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
