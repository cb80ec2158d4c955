"""Column functions on paths and names: kinds, filters, safe names, device folders and target paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of media files, by kind.
IMAGE = ("jpg", "jpeg", "png", "heic", "heif", "webp", "bmp", "gif", "tiff", "tif")
RAW = ("cr2", "cr3", "nef", "arw", "dng", "raf", "rw2", "orf", "pef", "srw")
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "mts", "3gp")
EXTENSIONS = (*IMAGE, *RAW, *VIDEO)

# Directory names that are shown with a hint.
NAME_HINTS = {
    "node_modules": "cache",
    ".bun": "cache",
    ".git": "cache",
    ".cache": "cache",
    "__pycache__": "cache",
    ".venv": "cache",
    "venv": "cache",
    "appdata": "system",
    "system volume information": "system",
}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The lower-cased suffix without its dot; empty for names without one, such as ``.jpg``."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def is_candidate(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a path ends with one of the extensions, in any case. A file named just ``.jpg`` does."""
    return F.lower(path).rlike(rf"\.(?:{'|'.join(extensions)})\z")


def classify_kind(path: Column) -> Column:
    ext = suffix(path)
    return F.when(ext.isin(*IMAGE), "image").when(ext.isin(*RAW), "raw").when(ext.isin(*VIDEO), "video").otherwise("other")


def walkable(directory: Column) -> Column:
    """No component of a directory's path starts with ``$`` or ``_replaced``."""
    return ~F.exists(F.split(directory, "/"), lambda x: x.startswith("$") | x.startswith("_replaced"))


def name_hint(name: Column) -> Column:
    hints = F.create_map(*[F.lit(x) for pair in NAME_HINTS.items() for x in pair])
    return F.try_element_at(hints, F.lower(name))


def ancestors(relpath: Column) -> Column:
    """The directory itself and all above it, the root ('') first."""
    parts = F.filter(F.split(relpath, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def excluded_by_prefix(relpath: Column, excluded: Column) -> Column:
    """``relpath`` is ``excluded`` or stands below it; back slashes count as slashes, outer slashes don't count."""
    e = F.regexp_replace(F.translate(excluded, "\\", "/"), "^/+|/+$", "")
    return (relpath == e) | relpath.startswith(F.concat(e, F.lit("/")))


def safe_filename(name: Column) -> Column:
    """A name that any file system takes; ``unknown`` if nothing is left."""
    c = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "-")
    c = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    c = F.regexp_replace(c, r"[. ]+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "-+", "-")
    c = F.regexp_replace(c, "^-+|-+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def format_bytes(n: Column) -> Column:
    """Bytes below 1024 as they are, otherwise two decimals (ties to even) of KB to PB."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = n / float(1024**power)
        out = out.when(scaled < 1024, F.format_string(f"%.2f {unit}", F.bround(scaled, 2)))
    return out.otherwise(F.format_string("%.2f PB", F.bround(n / float(1024**5), 2)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def device_slug(make: Column, model: Column, serial: Column) -> Column:
    """Make, model and serial joined; a model that starts with the make stands for both."""
    blank = lambda c: c.isNull() | (c == "")
    parts = F.struct(*[F.when(~blank(c), safe_filename(c)).alias(n) for n, c in (("k", make), ("m", model), ("s", serial))])
    starts = lambda p: F.coalesce(F.lower(p["m"]).startswith(F.lower(p["k"])), F.lit(False))
    return let(parts, lambda p: F.coalesce(F.nullif(F.concat_ws("-", F.when(~starts(p), p["k"]), p["m"], p["s"]), F.lit("")), F.lit("unknown-device")))


def parse_date(text: Column) -> Column:
    """A timestamp from one of three strict formats, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")])


def target_path(date: Column, source: Column, make: Column, model: Column, serial: Column, sha256: Column, winner_path: Column, mtime: Column) -> Column:
    """``{date}{-s}-{device}/{time}_{sha8}.{ext}``, relative to the output root."""
    fallback = F.when(mtime != 0, F.timestamp_seconds(mtime))
    device = device_slug(make, model, serial)
    sha8 = F.substring(F.coalesce(F.nullif(sha256, F.lit("")), F.lit("00000000")), 1, 8)
    ext = F.coalesce(F.nullif(suffix(winner_path), F.lit("")), F.lit("bin"))

    def placed(p: Column) -> Column:
        mark = F.when(p["parsed"].isNotNull() & ((source != "mtime") | source.isNull()), "").otherwise("-s")
        day = F.when(p["at"].isNull(), "unknown-date").otherwise(F.concat(F.date_format(p["at"], "yyyy-MM-dd"), mark))
        return F.concat(day, F.lit("-"), device, F.lit("/"), F.coalesce(F.date_format(p["at"], "HHmmss"), F.lit("000000")), F.lit("_"), sha8, F.lit("."), ext)

    return let(let(parse_date(date), lambda d: F.struct(d.alias("parsed"), F.coalesce(d, fallback).alias("at"))), placed)


def cluster_label(cluster_id: Column, date: Column, source: Column, members: Column) -> Column:
    label = F.format_string("#%d · %s · %d copies", cluster_id, F.coalesce(F.nullif(date, F.lit("")), F.lit("unknown date")), members)
    return F.concat(label, F.when(source == "mtime", " (save date)").otherwise(""))


def decode_label(decode_ok: Column) -> Column:
    return F.when(decode_ok.isNull(), "?").when(decode_ok, "ok").otherwise("fail")
