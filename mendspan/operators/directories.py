"""Directory operators: discovery counts, recursive rollup, noise, selection, resume and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendspan.functions.names import EXTENSIONS, ancestors, base_name, excluded_by_prefix, is_candidate

#: A directory of at least so many files with a smaller share of media is noise.
LEAST_FILES, MEDIA_RATIO = 20, 0.01


def directory_of(relpath: Column) -> Column:
    """The directory part of a file's relative path; '' at the root."""
    return F.regexp_replace(F.regexp_replace(relpath, r"[^/]*\z", ""), r"/\z", "")


def discover(files: DataFrame, directories: DataFrame | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(relpath, own_total, own_media) of each directory from files (relpath); listed directories without files count 0."""
    own = files.select(directory_of(F.col("relpath")).alias("relpath"), is_candidate(F.col("relpath"), extensions).alias("media"))
    own = own.groupBy("relpath").agg(F.count("*").alias("own_total"), F.count_if("media").alias("own_media"))
    if directories is None:
        return own
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return directories.select("relpath").distinct().join(own, "relpath", "full").select("relpath", zero("own_total"), zero("own_media"))


def rollup(own: DataFrame, least_files: int = LEAST_FILES, ratio: float = MEDIA_RATIO) -> DataFrame:
    """Recursive counts for every directory and all above it, with depth, parent, name and the noise flag."""
    own = own.groupBy("relpath").agg(F.sum("own_total").alias("own_total"), F.sum("own_media").alias("own_media"))
    spread = own.select(F.explode(ancestors(F.col("relpath"))).alias("at"), "relpath", "own_total", "own_media")
    mine = lambda c: F.sum(F.when(F.col("at") == F.col("relpath"), F.col(c)).otherwise(0)).alias(c)
    total = spread.groupBy("at").agg(mine("own_total"), mine("own_media"), F.sum("own_total").alias("total_files"), F.sum("own_media").alias("media_files"))
    at = F.col("at")
    depth = F.when(at == "", 0).otherwise(F.size(F.split(at, "/")))
    return total.select(at.alias("relpath"), base_name(at).alias("name"), depth.alias("depth"), F.when(at != "", directory_of(at)).alias("parent"), "own_total", "own_media", "total_files", "media_files", noise(F.col("total_files"), F.col("media_files"), least_files, ratio).alias("flagged"))


def noise(total: Column, media: Column, least_files: int = LEAST_FILES, ratio: float = MEDIA_RATIO) -> Column:
    return (total >= least_files) & (F.try_divide(media, total) < ratio)


def default_checked(tree: DataFrame, skip_noise: bool = True) -> DataFrame:
    return tree.filter(~(F.lit(skip_noise) & F.col("flagged"))).select("relpath")


def include_by_prefix(directories: DataFrame, excluded: DataFrame) -> DataFrame:
    """Directories that neither are nor stand below an excluded one (excluded); the root always stays.

    The directory's own ancestors are matched with the excluded paths by equality, so any number of them is a hash join.
    """
    e = excluded.select(F.regexp_replace(F.translate("excluded", "\\", "/"), "^/+|/+$", "").alias("at")).distinct()
    hit = directories.select("relpath", F.explode(ancestors(F.col("relpath"))).alias("at")).filter("at <> ''").join(e, "at", "left_semi")
    return directories.join(hit.select("relpath").distinct(), "relpath", "left_anti")


def include_exact(directories: DataFrame, checked: DataFrame) -> DataFrame:
    """Directories that a walk reaches when only checked ones are entered: all of their ancestors but the root are checked."""
    steps = directories.select("relpath", F.explode(ancestors(F.col("relpath"))).alias("at")).filter("at <> ''")
    barred = steps.join(checked.select(F.col("relpath").alias("at")).distinct(), "at", "left_anti").select("relpath").distinct()
    return directories.join(barred, "relpath", "left_anti")


def resume(directories: DataFrame, completed: DataFrame) -> DataFrame:
    """Directories still to be read: neither complete themselves nor below a complete one; a complete root bars only itself."""
    steps = directories.select("relpath", F.explode(ancestors(F.col("relpath"))).alias("at")).filter("at <> '' OR relpath = ''")
    done = steps.join(completed.select(F.col("relpath").alias("at")).distinct(), "at", "left_semi").select("relpath").distinct()
    return directories.join(done, "relpath", "left_anti")


def complete(tree: DataFrame, pruned: DataFrame) -> DataFrame:
    """(relpath, file_count, media_count) of directories whose whole subtree was read: no pruned one is in it."""
    blocked = pruned.select(F.explode(ancestors(F.col("relpath"))).alias("relpath")).distinct()
    return tree.join(blocked, "relpath", "left_anti").select("relpath", F.col("total_files").alias("file_count"), F.col("media_files").alias("media_count"))


def print_tree(tree: DataFrame) -> DataFrame:
    """(position, line): the tree as indented text, siblings by name."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("name") == "", "/").otherwise(F.col("name")), F.format_string("  (%d/%d media)", "media_files", "total_files"), F.when(F.col("flagged"), " [noise]").otherwise(""))
    return tree.select(F.split("relpath", "/").alias("position"), line.alias("line")).orderBy("position")


__all__ = ["complete", "default_checked", "directory_of", "discover", "excluded_by_prefix", "include_by_prefix", "include_exact", "noise", "print_tree", "resume", "rollup"]
