"""The stages of a media library over the catalogue store: scan, hash, analyse, cluster, select, organize, report."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.functions import integrity, metadata, names
from mendspan.operators import catalog, clusters, directories, fingerprints, organize, report, select
from mendspan.session import written
from mendspan.sources import content, mediatree
from mendspan.sources.store import Store


def now_iso() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Library:
    def __init__(self, store: Store) -> None:
        self.store, self.spark = store, store.spark
        mediatree.register(self.spark)

    def walk(self, source: str, skip: tuple[str, ...] = ()) -> DataFrame:
        return self.spark.read.format("mediatree").option("path", source).option("skip", json.dumps(list(skip))).load()

    def discover(self, source: str, ratio: float = directories.MEDIA_RATIO) -> DataFrame:
        """The directory tree with recursive counts and noise flags; nothing is stored."""
        found = written(self.walk(source))
        return directories.rollup(directories.discover(found.filter("NOT is_dir"), found.filter("is_dir")), ratio=ratio)

    def scan(self, source: str, label: str | None = None, exclude: tuple[str, ...] = (), include: DataFrame | None = None, resume: bool = True, skip_indexed: bool = True, force: bool = False) -> dict:
        """Indexes media files of a tree; directories that were read whole are marked, and left out next time.

        A drive is a volume and a root on it, so that two roots of one volume keep apart what they hold.
        """
        now = F.lit(now_iso())
        serial = f"{mediatree.volume_serial(source)}:{os.path.abspath(source)}"
        drive = self.spark.createDataFrame([(serial, label or mediatree.volume_label(source), source)], "volume_serial string, label string, source_root string")
        self.store.commit("drives", catalog.upsert_drives(self.store.read("drives"), drive, now))
        drive_id = F.conv(F.substring(F.sha2(F.lit(serial), 256), 1, 15), 16, 10).cast("long")
        done = self.store.read("scanned_dirs").filter(F.col("drive_id") == drive_id)
        found = written(self.walk(source, exclude))
        dirs = found.filter("is_dir AND readable").select("relpath").distinct()
        wanted = dirs
        if exclude:
            wanted = directories.include_by_prefix(wanted, self.spark.createDataFrame([(x,) for x in exclude], "excluded string"))
        if include is not None:
            wanted = directories.include_exact(wanted, include)
        unread = dirs.join(wanted, "relpath", "left_anti").unionByName(self.spark.createDataFrame([(x,) for x in exclude], "relpath string"))
        pruned = written(unread.unionByName(found.filter("is_dir AND NOT readable").select("relpath")))
        reading = written(directories.resume(wanted, done) if resume and not force else wanted)
        files = found.filter("NOT is_dir").withColumn("dir", directories.directory_of(F.col("relpath")))
        media = files.join(reading.select(F.col("relpath").alias("dir")), "dir", "left_semi").filter(names.is_candidate(F.col("relpath")))
        new = media.select(F.xxhash64("path").alias("file_id"), "path", drive_id.alias("drive_id"), "relpath", "size", "mtime", names.classify_kind(F.col("path")).alias("kind"))
        known = self.store.read("files")
        if skip_indexed and not force:
            new = new.join(known.select("drive_id", "relpath"), ["drive_id", "relpath"], "left_anti")
        inserted = written(catalog.insert_ignore(known, new))
        self.store.commit("files", known.unionByName(inserted.select(*known.columns)))
        tree = directories.rollup(directories.discover(files.select("relpath"), dirs))
        marks = directories.complete(tree.join(wanted, "relpath", "left_semi"), pruned).select(drive_id.alias("drive_id"), "relpath", "file_count", "media_count", now.alias("completed_at"))
        self.store.commit("scanned_dirs", catalog.latest(self.store.read("scanned_dirs").unionByName(marks), ["drive_id", "relpath"], F.col("completed_at")))
        return {"inserted": inserted.count(), "seen": media.count(), "inaccessible_dirs": found.filter("is_dir AND NOT readable").count()}

    def _stage(self, name: str, new: DataFrame, key: str = "file_id") -> DataFrame:
        """Adds rows to a stage's table; newer rows replace older ones of the same file."""
        old = self.store.read(name)
        new = written(new)
        return self.store.commit(name, old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns)))

    def quickhash(self) -> dict:
        todo = self.store.read("files").join(self.store.read("quick").filter("quick_hash IS NOT NULL"), "file_id", "left_anti")
        return self._hashed("quick", "quick_hash", todo, "quickhash")

    def fullhash(self) -> dict:
        files = self.store.read("files").join(self.store.read("quick").select("file_id", "quick_hash"), "file_id")
        todo = fingerprints.colliding(files).join(self.store.read("full").filter("sha256 IS NOT NULL"), "file_id", "left_anti")
        told = self._hashed("full", "sha256", todo, "fullhash")
        # files that collide with none are through with this stage as well; a later collision takes them up again
        alone = fingerprints.not_colliding(files).join(self.store.read("full"), "file_id", "left_anti")
        self._stage("full", alone.select("file_id", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("error")))
        return told

    def _hashed(self, name: str, column: str, todo: DataFrame, stage: str) -> dict:
        done = written(content.hash_stage(todo, stage).withColumnRenamed("hash", column))
        self._stage(name, done)
        return done.agg(F.count(column).alias("done"), F.count("error").alias("errors"), F.count("*").alias("total")).first().asDict()

    def analyze(self, limit: int | None = None) -> dict:
        """Decodes, hashes and describes files not analysed yet; one that fails is marked and not tried again."""
        todo = self.store.read("files").join(self.store.read("analysis"), "file_id", "left_anti")
        todo = written(todo if limit is None else todo.orderBy("path").limit(limit))
        paths = [r["path"] for r in todo.filter("kind <> 'video'").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).distinct().collect()]
        looked = None
        if paths:
            images = self.spark.read.format("image").option("dropInvalid", False).load(paths)
            looked = content.analyze_images(images).withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace("origin", "^file:/+", "/"), r"\+", "%2B"))).drop("origin")
        else:
            looked = self.spark.createDataFrame([], "decode_ok boolean, width int, height int, valid_rows int, phash long, dhash long, path string")
        rows = todo.join(looked, "path", "left").join(content.describe_files(todo), "file_id")
        video = F.col("kind") == "video"
        rows = rows.withColumn("decode_ok", F.when(video, F.col("video_phash").isNotNull()).otherwise(F.coalesce("decode_ok", F.lit(False))))
        rows = rows.withColumn("phash", F.coalesce("video_phash", "phash")).withColumn("dhash", F.coalesce("video_dhash", "dhash"))
        rows = rows.withColumn("m", metadata.resolve(metadata.tags(F.col("tag_json")), F.col("mtime"))).withColumn("end_ok", integrity.jpeg_end(F.col("path"), F.col("tail"))).select("*", "m.*")
        score = integrity.quality_score(*[F.col(c) for c in ("decode_ok", "valid_rows", "height", "size", "has_full_exif", "capture_time", "end_ok")])
        self._stage("analysis", rows.withColumn("quality_score", score))
        return self.store.read("analysis").agg(F.count("*").alias("done"), F.count_if(~F.col("decode_ok")).alias("errors")).first().asDict()

    def files(self) -> DataFrame:
        """Files with what all stages know of them: ``error`` is the last failure, ``last_stage_done`` the stage that is over."""
        s = self.store
        quick, full = s.read("quick").withColumnRenamed("error", "quick_error"), s.read("full").select("file_id", "sha256", F.col("error").alias("full_error"), F.lit(True).alias("in_full"))
        rows = s.read("files").join(quick, "file_id", "left").join(full, "file_id", "left").join(s.read("analysis"), "file_id", "left")
        hashed = F.col("in_full") & F.col("full_error").isNull()
        stage = F.when(F.col("date_source").isNotNull(), 3).when(hashed, 2).when(F.col("quick_hash").isNotNull(), 1).otherwise(0)
        return rows.withColumn("last_stage_done", stage).withColumn("error", F.coalesce("full_error", "quick_error")).drop("quick_error", "full_error", "in_full")

    def cluster(self, hamming: int = clusters.HAMMING) -> dict:
        rows = written(self.files())
        assigned = written(clusters.assign(rows, hamming))
        self.store.commit("members", assigned)
        return assigned.groupBy("cluster_id").count().agg(F.count("*").alias("clusters"), F.sum("count").alias("files"), F.count_if(F.col("count") > 1).alias("non_singletons")).first().asDict()

    def select(self) -> DataFrame:
        rows = written(self.files().join(self.store.read("members"), "file_id"))
        return self.store.commit("clusters", clusters.summary(rows).join(select.choose(rows), "cluster_id"))

    def organize(self, output: str, dry_run: bool = False) -> dict:
        """Writes what the plan has and the output hasn't; a dry run tells the same counts and writes nothing."""
        now = now_iso()
        planned = written(organize.without_clashes(organize.plan(self.store.read("clusters"), self.files())))
        ledger = self.store.read("ledger")
        present = organize.there(planned.select(F.col("winner_path").alias("path")))
        existing = organize.there(ledger.select(F.col("target_path").alias("path")), output).select(F.col("path").alias("target_path"))
        actions = written(organize.difference(planned, ledger, present, existing))
        if dry_run:
            return organize.totals(actions.withColumn("error", F.lit(None).cast("string"))).first().asDict()
        done = written(organize.copy_out(actions, output, now[:10]))
        told = written(actions.join(done, "winner_id", "left"))
        good = told.filter("error IS NULL")
        organize.manifest(good, F.lit(now)).write.mode("append").option("header", True).csv(f"{output}/manifest")
        wrote = good.filter(F.col("action").isin("write", "replace")).select("cluster_id", F.col("winner_id").alias("organized_from_id"), "target_path", F.lit(now).alias("organized_at"))
        self._stage("ledger", wrote, "organized_from_id")
        return organize.totals(told).first().asDict()

    def status(self) -> dict:
        return report.status(self.files(), self.store.read("clusters")).first().asDict()

    def run_all(self, source: str, output: str, label: str | None = None, dry_run: bool = False) -> dict:
        out = {"scan": self.scan(source, label, resume=False, skip_indexed=False), "quickhash": self.quickhash(), "fullhash": self.fullhash(), "analyze": self.analyze(), "cluster": self.cluster()}
        self.select()
        return {**out, "organize": self.organize(output, dry_run)}
