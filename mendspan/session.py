"""Session helpers shared by the library: shared scratch folder, written intermediates, table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mendspan-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the re-read table.

    This cuts lineage, gives the optimizer true sizes, and survives lost executors. The folder goes with ``drop``, at the
    latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/mendspan-{uuid.uuid4().hex}"
    jpath, fs = _place(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _place(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables: nothing may read them any more.

    A collection of the driver's garbage follows, upon which Spark deletes the shuffle files of queries that are over.
    """
    for x in tables:
        if path := getattr(x, "_written", None):
            jpath, fs = _place(x.sparkSession, path)
            fs.delete(jpath, True)
            fs.cancelDeleteOnExit(jpath)
    for x in tables[:1]:
        x.sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
