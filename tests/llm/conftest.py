import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpora import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    long = prose(rng, 60_000, 5000)
    text = prose(rng, 120)
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, None, None, None), (None, text, "fr", "b", 1), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "  \n\t ", "en", "a", 5), (6, long, "en", "b", 9), (7, long + " end", "en", "b", 9), (8, "a" * 300_000, "de", "c", 1), (9, "word", "en", "c", 4), (10, "\n".join(["same line of six words here"] * 50), "en", "c", 1), (11, "é ü 漢字 😀 " * 40, "de", "c", 1), (12, "1" * 5000 + " @ " + "." * 5000 + "+1" * 3000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "size", "start", "node", "sim", "n", "rep", "cluster", "line", "place", "slot", "target", "anchor", "digest", "kind", "end", "found", "epoch", "words", "all", "mean", "limit"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
