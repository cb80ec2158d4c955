"""Two-stage fingerprints: a quick one for all files, a full one only where quick ones collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.functions.hashes import full_hash, quick_digest


def quick(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("quick_hash", quick_digest(F.col(content), F.col("size")))


def collision_groups(files: DataFrame) -> DataFrame:
    """(quick_hash, n) of quick hashes that more than one file has."""
    return files.filter("quick_hash IS NOT NULL").groupBy("quick_hash").agg(F.count("*").alias("n")).filter("n > 1")


def colliding(files: DataFrame) -> DataFrame:
    return files.join(collision_groups(files).select("quick_hash"), "quick_hash", "left_semi")


def not_colliding(files: DataFrame) -> DataFrame:
    """Files that need no full hash; those without a quick hash are still to be done and not among them."""
    return files.filter("quick_hash IS NOT NULL").join(collision_groups(files).select("quick_hash"), "quick_hash", "left_anti")


def full(files: DataFrame, content: str = "content") -> DataFrame:
    """Full hashes of the colliding files alone: the semi-join stands before the hash."""
    return colliding(files).withColumn("sha256", full_hash(F.col(content)))
