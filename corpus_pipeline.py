"""The corpus pipeline: each stage reads the documents that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands the re-read table
to the next. All but the last return the columns of documents. The last returns the mix in order: a row for each
document and epoch, with the words of it that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendspan.llm import chosen_path, lines, mixing, perplexity, templates
from mendspan.llm.common import bounded_batches, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Stands for a null id where rows are matched.
LAST = (1 << 63) - 1


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] for c in COLUMNS])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``. Ids grow with the corpus, so they are never broadcast."""
    gone = ids.select(F.coalesce(ids["doc_id"], F.lit(LAST)).alias("_gone")).distinct().hint("merge")
    return docs.join(gone, F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col("_gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps."""
    bounded_batches(spark)
    docs = _columns(docs)
    told = perplexity.classify(docs, perplexity.trusted(table(spark, sf_dir, "labels")))
    bad = told.filter(~F.col("kept")).select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("digest").alias("_digest")).distinct().hint("merge")
    return docs.join(bad, (F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_digest")), "left_anti")


def deduplicated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere before; those left without any word go."""
    kept = lines.dedup_lines(_columns(docs))
    changed = F.col("n_removed") > 0
    kept = kept.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates; null ids come last, by text."""
    bounded_batches(spark)
    by_text = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    docs = _columns(docs).withColumn("_key", F.coalesce("doc_id", by_text))
    classes = chosen_path.jaccard_classes(docs.select(F.col("_key").alias("doc_id"), "text"))
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct().hint("merge")
    kept = docs.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _columns(kept.filter(~nameless).unionByName(kept.filter(nameless).dropDuplicates(["_key"])))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    docs = _columns(docs)
    return _without(docs, templates.matches(docs, table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights, in order."""
    return mixing.mix(_columns(docs))


STAGES = [
    ("quality", quality),
    ("lines", deduplicated_lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
]

#: SimHash, chosen paths and the language model can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
