"""The catalogue as versioned Parquet: each commit writes a new version and then moves a pointer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the catalogue's tables.
SCHEMAS = {
    "drives": "volume_serial string, label string, source_root string, first_seen string, last_seen string, online boolean",
    "files": "file_id long, path string, drive_id long, relpath string, size long, mtime double, kind string",
    "quick": "file_id long, quick_hash string, error string",
    "full": "file_id long, sha256 string, error string",
    "analysis": "file_id long, decode_ok boolean, width int, height int, valid_rows int, phash long, dhash long, end_ok boolean, capture_time string, camera_make string, camera_model string, camera_serial string, lens_model string, has_full_exif boolean, effective_date string, date_source string, quality_score double",
    "scanned_dirs": "drive_id long, relpath string, file_count long, media_count long, completed_at string",
    "clusters": "cluster_id long, member_count long, kind string, winner_id long, donor_id long, effective_date string, effective_date_source string",
    "members": "file_id long, cluster_id long",
    "ledger": "cluster_id long, organized_from_id long, target_path string, organized_at string",
    "meta": "key string, value string",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        place = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(place):
            return []
        found = (x.getPath() for x in self._fs.listStatus(place))
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and self._fs.exists(self._path(f"{p}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The latest whole version; empty before the first commit."""
        versions = self.versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def commit(self, name: str, rows: DataFrame) -> DataFrame:
        """A version counts once its writer has marked it whole; readers of the one before aren't disturbed."""
        new = (self.versions(name) or [0])[-1] + 1
        columns = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{new}")
        return self.read(name)

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        found = self.read("meta").filter(F.col("key") == key).first()
        return found["value"] if found else default

    def set_meta(self, key: str, value: str) -> None:
        rest = self.read("meta").filter(F.col("key") != key)
        self.commit("meta", rest.unionByName(self.spark.createDataFrame([(key, value)], SCHEMAS["meta"])))
