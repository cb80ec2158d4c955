"""Reports: pipeline counters, drives, clusters with most members, their members, one file's details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.functions.names import base_name, cluster_label, decode_label, format_bytes


def status(files: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of counters, in one pass over files and one over clusters."""
    at_least = lambda n, name: F.count_if(F.col("last_stage_done") >= n).alias(name)
    f = files.agg(F.count("*").alias("total_files"), at_least(0, "scanned"), at_least(1, "quickhashed"), at_least(2, "fullhashed"), at_least(3, "analyzed"), F.count("error").alias("errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    c = clusters.agg(F.count("*").alias("clusters"), F.count("winner_id").alias("winners"))
    return f.crossJoin(c)


def drives(rows: DataFrame) -> DataFrame:
    return rows.orderBy("first_seen", "volume_serial")


def top_clusters(clusters: DataFrame, most: int = 500) -> DataFrame:
    """Clusters of several members, largest first, then latest date; those without date last."""
    return clusters.filter("member_count > 1").orderBy(F.desc("member_count"), F.desc_nulls_last("effective_date"), "cluster_id").limit(most).withColumn("label", cluster_label(F.col("cluster_id"), F.col("effective_date"), F.col("effective_date_source"), F.col("member_count")))


def members(files: DataFrame) -> DataFrame:
    """Members of clusters as they are shown: (cluster_id, file_id, shown, size_text, score_text, decode, path)."""
    name = F.concat(F.when(F.col("is_winner"), "★ ").otherwise(""), base_name(F.col("path")))
    score = F.format_string("%.0f", F.bround(F.coalesce("quality_score", F.lit(0.0)), 0))
    return files.select("cluster_id", "file_id", name.alias("shown"), format_bytes(F.coalesce("size", F.lit(0))).alias("size_text"), score.alias("score_text"), decode_label(F.col("decode_ok")).alias("decode"), "path")


def detail(files: DataFrame, file_id: int) -> DataFrame:
    return files.filter(F.col("file_id") == file_id)
