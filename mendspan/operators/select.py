"""Choice within clusters: winner by content, donor by metadata, best date. Ties go to the smallest file_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.functions.metadata import source_rank


def _best(files: DataFrame, *rank) -> DataFrame:
    """For each cluster the file of the greatest rank. A maximum of structs combines before the shuffle, however large a cluster is."""
    top = F.max(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], (-F.col("file_id")).alias("last")))
    return files.groupBy("cluster_id").agg((-top["last"]).alias("file_id"))


def winners(files: DataFrame) -> DataFrame:
    score = F.coalesce("quality_score", F.lit(0.0))
    found = _best(files, score, F.coalesce("size", F.lit(0)), F.coalesce(F.col("has_full_exif"), F.lit(False)).cast("int"))
    return found.select("cluster_id", F.col("file_id").alias("winner_id"))


def donors(files: DataFrame) -> DataFrame:
    filled = lambda c: (F.col(c).isNotNull() & (F.col(c) != "")).cast("int")
    found = _best(files, F.coalesce(F.col("has_full_exif"), F.lit(False)).cast("int"), filled("camera_serial") + filled("lens_model"), F.coalesce("quality_score", F.lit(0.0)).cast("long"))
    return found.select("cluster_id", F.col("file_id").alias("donor_id"))


def dates(files: DataFrame) -> DataFrame:
    """(cluster_id, effective_date, effective_date_source): of the best ranked source; null if none has a date."""
    rank = source_rank(F.col("date_source"))
    usable = (rank > 0) & F.col("effective_date").isNotNull() & (F.col("effective_date") != "")
    top = F.max(F.when(usable, F.struct(rank.alias("rank"), (-F.col("file_id")).alias("last"), "effective_date", "date_source")))
    return files.groupBy("cluster_id").agg(top.alias("t")).select("cluster_id", F.col("t.effective_date").alias("effective_date"), F.col("t.date_source").alias("effective_date_source"))


def choose(files: DataFrame) -> DataFrame:
    """Clusters with winner, donor and date."""
    return winners(files).join(donors(files), "cluster_id").join(dates(files), "cluster_id")
