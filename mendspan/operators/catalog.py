"""Catalogue operators: insert-or-ignore, upserts, patches and work lists over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` to insert: first of its path and of its (drive_id, relpath), neither of which the catalogue has.

    Rows are taken in the order of their paths, as they would be one after the other.
    """
    by_path = Window.partitionBy("path").orderBy("file_id")
    by_place = Window.partitionBy("drive_id", "relpath").orderBy("path")
    once = new.withColumn("_n", F.row_number().over(by_path)).filter("_n = 1")
    once = once.join(catalog.select("path"), "path", "left_anti").join(catalog.select("drive_id", "relpath"), ["drive_id", "relpath"], "left_anti")
    return once.withColumn("_n", F.row_number().over(by_place)).filter("_n = 1").drop("_n")


def upsert_drives(drives: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Drives after a scan: seen ones are online with the time; label and root change only where given."""
    s = seen.select(F.col("volume_serial"), F.col("label").alias("_label"), F.col("source_root").alias("_root"), F.lit(True).alias("_seen"))
    joined = drives.join(s, "volume_serial", "full")
    is_seen = F.coalesce("_seen", F.lit(False))
    return joined.select(
        "volume_serial",
        F.coalesce("_label", "label").alias("label"),
        F.coalesce("_root", "source_root").alias("source_root"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(is_seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce(is_seen | F.col("online"), F.lit(True)).alias("online"),
    )


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key: what an upsert that overwrites all else leaves."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``changes`` where those hold a value."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def check_foreign_key(rows: DataFrame, column: str, known: DataFrame, key: str) -> None:
    """Raises if a row's column has no counterpart."""
    lost = rows.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)), column, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{column} {lost[0][column]} is not in the referenced table")


def pending(files: DataFrame, stage: int, limit: int | None = None) -> DataFrame:
    """Files whose last stage is the one before, in the order of their paths."""
    rows = files.filter(F.col("last_stage_done") == stage - 1)
    return rows if limit is None else rows.orderBy("path").limit(limit)
