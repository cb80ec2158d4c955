"""Clusters of versions of one item: exact and near links, components, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendspan.functions.hashes import bucket, hamming
from mendspan.operators.graph import connected_components
from mendspan.session import written

HAMMING = 8


def exact_links(files: DataFrame) -> DataFrame:
    """Star links (a, b) from the first file of each full hash to the others."""
    first = files.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("file_id").alias("a"))
    return files.join(first, "sha256").filter("file_id > a").select("a", F.col("file_id").alias("b"))


def representatives(files: DataFrame) -> DataFrame:
    """One file (rep) of each pair of perceptual hashes, dhash falling back to phash."""
    return files.filter("phash IS NOT NULL").groupBy("phash", F.coalesce("dhash", "phash").alias("dhash")).agg(F.min("file_id").alias("rep"), F.count("*").alias("copies"))


def near_pairs(files: DataFrame, threshold: int = HAMMING) -> DataFrame:
    """(a, b) of representatives in one bucket of the top 16 bits, with either hash within ``threshold`` bits."""
    reps = representatives(files).withColumn("bucket", bucket(F.col("phash")))
    x, y = reps.alias("x"), reps.alias("y")
    close = (hamming(F.col("x.phash"), F.col("y.phash")) <= threshold) | (hamming(F.col("x.dhash"), F.col("y.dhash")) <= threshold)
    return x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & close).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def near_links(files: DataFrame, threshold: int = HAMMING) -> DataFrame:
    """Links that join what all near pairs join: pairs of representatives, and stars to the files with equal hashes."""
    reps = representatives(files)
    same = files.filter("phash IS NOT NULL").select("file_id", "phash", F.coalesce("dhash", "phash").alias("dhash")).join(reps, ["phash", "dhash"]).filter("file_id > rep")
    return near_pairs(files, threshold).unionByName(same.select(F.col("rep").alias("a"), F.col("file_id").alias("b")))


def assign(files: DataFrame, threshold: int = HAMMING) -> DataFrame:
    """(file_id, cluster_id): every file in one cluster, numbered by its smallest file."""
    links = written(exact_links(files).unionByName(near_links(files, threshold)))
    found = connected_components(links).select(F.col("node").alias("file_id"), F.col("root").alias("cluster_id"))
    alone = files.select("file_id").join(found, "file_id", "left_anti").select("file_id", F.col("file_id").alias("cluster_id"))
    return found.unionByName(alone)


def summary(files: DataFrame) -> DataFrame:
    """(cluster_id, member_count, kind) from files with cluster_id; the kind is the first file's, image if it has none."""
    return files.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.coalesce(F.min_by(F.col("kind"), F.col("file_id")), F.lit("image")).alias("kind"))


def singletons(files: DataFrame) -> DataFrame:
    alone = files.withColumn("_n", F.count("*").over(Window.partitionBy("cluster_id")))
    return alone.filter("_n = 1").drop("_n")
