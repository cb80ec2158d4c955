"""Column functions on descriptive metadata: date strings, tag JSON, resolution of fields, date sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAKEN, CREATED, MTIME = "exif_taken", "exif_created", "mtime"
#: Tags asked for; numbers come as strings.
TAGS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "Make", "Model", "SerialNumber", "InternalSerialNumber", "LensModel")
_DATE = r"^\s*(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})[\s\S]*$"


def exif_datetime(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` from a date with ``:`` or ``-``; what follows the seconds is ignored, ranges are not checked."""
    return F.when(text.rlike(_DATE), F.regexp_replace(text, _DATE, "$1-$2-$3 $4:$5:$6"))


def mtime_iso(mtime: Column) -> Column:
    return F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd HH:mm:ss")


def tags(json: Column) -> Column:
    """The first element of the tag tool's JSON array, as a struct of strings; null if it can't be read."""
    return F.get(F.from_json(json, f"array<struct<{','.join(f'{t}:string' for t in TAGS)}>>"), F.lit(0))


def present(text: Column) -> Column:
    """Stripped, null if empty."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", ""), F.lit(""))


def _first(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in texts])


def resolve(t: Column, mtime: Column) -> Column:
    """Struct of capture_time, camera fields, has_full_exif, effective_date and date_source from a tag struct."""
    taken = exif_datetime(t["DateTimeOriginal"])
    created = exif_datetime(_first(t["CreateDate"], t["MediaCreateDate"]))
    capture = F.coalesce(taken, created)
    make, model = present(t["Make"]), present(t["Model"])
    return F.struct(
        capture.alias("capture_time"),
        make.alias("camera_make"),
        model.alias("camera_model"),
        present(_first(t["SerialNumber"], t["InternalSerialNumber"])).alias("camera_serial"),
        present(t["LensModel"]).alias("lens_model"),
        (capture.isNotNull() & make.isNotNull() & model.isNotNull()).alias("has_full_exif"),
        F.coalesce(capture, mtime_iso(mtime)).alias("effective_date"),
        F.when(taken.isNotNull(), TAKEN).when(created.isNotNull(), CREATED).otherwise(MTIME).alias("date_source"),
    )


def source_rank(source: Column) -> Column:
    return F.when(source == TAKEN, 3).when(source == CREATED, 2).when(source == MTIME, 1).otherwise(0)


def better_source(a: Column, b: Column) -> Column:
    return F.when(source_rank(a) >= source_rank(b), a).otherwise(b)
