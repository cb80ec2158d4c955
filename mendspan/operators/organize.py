"""The output layout: a pure plan, its difference to what was written before, the manifest, and the copy action."""

from __future__ import annotations

import os
import shutil
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendspan.functions.names import target_path


def plan(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """A row a cluster with its winner's and donor's data and the target path."""
    w = files.select(F.col("file_id").alias("winner_id"), F.col("path").alias("winner_path"), F.col("sha256").alias("winner_sha"), F.col("mtime").alias("winner_mtime"), F.col("quality_score").alias("quality_score"))
    d = files.select(F.col("file_id").alias("donor_id"), F.col("path").alias("donor_path"), "camera_make", "camera_model", "camera_serial")
    rows = clusters.join(w, "winner_id").join(d, "donor_id", "left")
    return rows.withColumn("target_path", target_path(*[F.col(c) for c in ("effective_date", "effective_date_source", "camera_make", "camera_model", "camera_serial", "winner_sha", "winner_path", "winner_mtime")]))


def without_clashes(planned: DataFrame) -> DataFrame:
    """Targets that several clusters share get a number before the extension, by cluster."""
    n = F.row_number().over(Window.partitionBy("target_path").orderBy("cluster_id"))
    renamed = F.regexp_replace("target_path", r"(\.[^.]*)$", "")
    return planned.withColumn("_n", n).withColumn("target_path", F.when(F.col("_n") == 1, F.col("target_path")).otherwise(F.concat(renamed, F.lit("_"), (F.col("_n") - 1).cast("string"), F.regexp_extract("target_path", r"(\.[^.]*)$", 1)))).drop("_n")


def offline(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Plan rows whose winner isn't among the present paths (path)."""
    return planned.join(present.select(F.col("path").alias("winner_path")), "winner_path", "left_anti")


def difference(planned: DataFrame, ledger: DataFrame, present: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """The plan with an action: ``pending`` (winner offline), ``skip`` (written to the same target before, and still there), ``replace`` (it had another target), ``write``.

    The ledger (organized_from_id, target_path) is kept by winner, so it outlives reclustering. ``present``: paths (path) that can
    be read, ``existing``: outputs (target_path) that are there; without them all are.
    """
    old = ledger.select(F.col("organized_from_id").alias("winner_id"), F.col("target_path").alias("current_target"))
    if existing is not None:
        old = old.join(existing.select(F.col("target_path").alias("current_target"), F.lit(True).alias("_there")).distinct(), "current_target", "left")
    else:
        old = old.withColumn("_there", F.lit(True))
    joined = planned.join(old, "winner_id", "left")
    here = F.lit(True)
    if present is not None:
        joined = joined.join(present.select(F.col("path").alias("winner_path"), F.lit(True).alias("_here")).distinct(), "winner_path", "left")
        here = F.coalesce("_here", F.lit(False))
    same = (F.col("current_target") == F.col("target_path")) & F.coalesce("_there", F.lit(False))
    moved = F.col("current_target").isNotNull() & (F.col("current_target") != F.col("target_path"))
    action = F.when(~here, "pending").when(F.coalesce(same, F.lit(False)), "skip").when(moved, "replace").otherwise("write")
    return joined.withColumn("action", action).drop("_here", "_there")


def manifest(actions: DataFrame, now: Column) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = actions.filter(F.col("action").isin("write", "replace"))
    return rows.select("cluster_id", "winner_path", blank("donor_path"), "target_path", "quality_score", F.coalesce("effective_date_source", F.lit("")).alias("date_source"), now.alias("organized_at"))


def totals(actions: DataFrame) -> DataFrame:
    """Counts of what was done; ``error`` of an action is null where it went well."""
    wrote = F.col("action").isin("write", "replace")
    n = lambda c, name: F.count_if(c).alias(name)
    good = F.col("error").isNull()
    return actions.agg(n(wrote & good, "written"), n(F.col("action") == "skip", "skipped"), n((F.col("action") == "replace") & good, "replaced"), n(F.col("action") == "pending", "pending_offline"), n(~good, "errors"), F.count("*").alias("total_clusters"))


def inject(donor: str, target: str, tool: str | None = None) -> bool:
    """Copies all writable tags with the tag tool, if there is one. Failing is not an error."""
    tool = tool or shutil.which("exiftool")
    if not tool or donor == target:
        return False
    try:
        done = subprocess.run([tool, "-overwrite_original", "-TagsFromFile", donor, "-all:all", target], capture_output=True, timeout=30, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return False
    return done.returncode == 0


def quarantine(old: Path, root: Path, today: str) -> Path:
    """Moves a replaced output to ``_replaced/<today>/``, numbered if the name is taken."""
    folder = root / "_replaced" / today
    folder.mkdir(parents=True, exist_ok=True)
    place, n = folder / old.name, 0
    while place.exists():
        n += 1
        place = folder / f"{old.stem}_{n}{old.suffix}"
    return Path(shutil.move(str(old), str(place)))


def place(row, root: Path, today: str, attempt: int) -> None:
    """Copies a winner to its target: it is written beside and renamed, so that a second attempt repeats it harmlessly."""
    target = root / row.target_path
    target.parent.mkdir(parents=True, exist_ok=True)
    if row.action == "replace" and (root / row.current_target).exists():
        quarantine(root / row.current_target, root, today)
    beside = target.with_name(f"{target.name}.{attempt}.tmp")
    shutil.copy2(row.winner_path, beside)
    if row.donor_path and row.donor_path != row.winner_path:
        inject(row.donor_path, str(beside))
    os.replace(beside, target)


def copy_out(actions: DataFrame, output_root: str, today: str) -> DataFrame:
    """(winner_id, error) of each action that writes; a file that fails doesn't stop the others."""

    def task(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for rows in batches:
            errors = []
            for r in rows.itertuples():
                try:
                    place(r, Path(output_root), today, attempt)
                    errors.append(None)
                except OSError as e:
                    errors.append(f"organize: {e}"[:200])
            yield pd.DataFrame({"winner_id": rows["winner_id"], "error": pd.Series(errors, dtype=object)})

    todo = actions.filter(F.col("action").isin("write", "replace")).select("winner_id", "action", "winner_path", F.coalesce("donor_path", F.lit("")).alias("donor_path"), "target_path", "current_target")
    return todo.mapInPandas(task, "winner_id long, error string")


def there(paths: DataFrame, root: str = "") -> DataFrame:
    """Those of the paths (path) below ``root`` that exist."""

    def task(batches):
        for rows in batches:
            yield rows[[os.path.exists(os.path.join(root, x)) for x in rows["path"]]]

    return paths.select("path").mapInPandas(task, "path string")
