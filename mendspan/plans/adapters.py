"""Views of the driver's tables as files, drives and directories, in SQL that Spark and DuckDB both read.

The operators don't know them: they take the same columns from real media.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendspan.functions import integrity, metadata, names
from mendspan.operators import fingerprints
from mendspan.session import table

_LETTERS = "etaoinshrdlcumwfgypbvk"


def _hash_sql(lags: tuple[int, ...]) -> str:
    """A 64-bit hash that near copies share: whether one letter is more frequent than another, for 64 pairs."""
    n = len(_LETTERS)
    pairs = [(k, (k + lag) % n) for lag in lags for k in range(n)][:64]
    values = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return " + ".join(f"CASE WHEN n_{_LETTERS[a]} > n_{_LETTERS[b]} THEN CAST({f"'{v}'" if v < 0 else v} AS BIGINT) ELSE CAST(0 AS BIGINT) END" for (a, b), v in zip(pairs, values, strict=True))


_S = "CAST({} AS STRING)".format
_MADE = {
    "file_id": "doc_id",
    "drive_id": "CAST(substr(source, 4) AS BIGINT)",
    "text": "text",
    "relpath": f"concat(source, '/', lang, '/', {_S('doc_id')}, CASE doc_id % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.cr2' WHEN 3 THEN '.mp4' WHEN 4 THEN '.txt' WHEN 5 THEN '.JPG' WHEN 6 THEN '.heic' ELSE '' END)",
    "mtime": "CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1600000000 + doc_id * 3601 END AS DOUBLE)",
    "decode_ok": "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE doc_id % 13 <> 0 END",
    "height": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 100 + doc_id % 50 END",
    "valid_rows": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 160 END",
    "end_ok": "CASE WHEN doc_id % 8 IN (0, 5) THEN doc_id % 3 <> 0 END",
    "taken": f"CASE doc_id % 5 WHEN 0 THEN concat('20', {_S('10 + doc_id % 15')}, ':0', {_S('1 + doc_id % 9')}, ':1', {_S('doc_id % 10')}, ' 0', {_S('doc_id % 10')}, ':06:07') WHEN 1 THEN '2020-11-12T13:14:15+02:00' WHEN 2 THEN '' WHEN 3 THEN 'not a date' ELSE ' 2019:13:40 25:61:61.5 ' END",
    "created": "CASE doc_id % 4 WHEN 0 THEN '2018:01:02 03:04:05' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE '2017-07-08 09:10:11' END",
    "media_created": "CASE WHEN doc_id % 3 = 0 THEN '2016:05:06 07:08:09' END",
    "make": "CASE doc_id % 4 WHEN 0 THEN 'Canon' WHEN 1 THEN 'NIKON CORPORATION' WHEN 2 THEN '  ' END",
    "model": "CASE doc_id % 6 WHEN 0 THEN 'Canon EOS R5' WHEN 1 THEN 'NIKON D850' WHEN 2 THEN ' X: T|4. ' WHEN 4 THEN 'canon eos' WHEN 5 THEN '...' END",
    "serial": f"CASE WHEN doc_id % 3 = 0 THEN {_S('doc_id * 7')} END",
    "lens": "CASE WHEN doc_id % 5 < 2 THEN 'RF 24-70' END",
    "error": "CASE WHEN doc_id % 31 = 0 THEN 'quickhash: unreadable' END",
    "last_stage_done": "CAST(doc_id % 4 AS INT)",
} | {f"n_{c}": f"length(text) - length(replace(text, '{c}', ''))" for c in _LETTERS}
_TAG = lambda name, value, quote='"': f"CASE WHEN {value} IS NULL THEN '' ELSE concat('\"{name}\":{quote}', {value}, '{quote},') END"
_THEN = {c: c for c in _MADE if not c.startswith("n_")} | {
    "path": "concat('/mnt/', relpath)",
    "phash": _hash_sql((1, 2, 3)),
    "dhash": f"CASE WHEN file_id % 9 = 0 THEN NULL ELSE {_hash_sql((4, 5, 6))} END",
    "tag_json": f"CASE WHEN file_id % 19 = 0 THEN 'broken' WHEN file_id % 23 = 0 THEN '[]' ELSE concat('[{{', {_TAG('DateTimeOriginal', 'taken')}, {_TAG('CreateDate', 'created')}, {_TAG('MediaCreateDate', 'media_created')}, {_TAG('Make', 'make')}, {_TAG('Model', 'model')}, {_TAG('SerialNumber', 'serial', '')}, {_TAG('LensModel', 'lens')}, '\"End\":1}}]') END",
}

_DATE = r"^\s*(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(.|\s)*$"
_TAGGED = lambda name: f"CASE WHEN json_valid(tag_json) THEN nullif(json_extract_string(tag_json, '$[0].{name}'), '') END"
_EXIF = lambda c: rf"CASE WHEN regexp_matches({c}, '{_DATE}') THEN regexp_replace({c}, '{_DATE}', '\1-\2-\3 \4:\5:\6') END"
_PRESENT = lambda c: f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"

#: DuckDB: the views ``f`` (files with all columns).
FILES_SQL = f"""
a1 AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _MADE.items())} FROM documents),
a2 AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _THEN.items())} FROM a1),
a3 AS (SELECT *, CAST(strlen(text) AS BIGINT) AS size, lower(regexp_extract(relpath, '[^/]\\.([^./]+)$', 1)) AS ext,
  {_EXIF(_TAGGED('DateTimeOriginal'))} AS t_taken, {_EXIF(f"coalesce({_TAGGED('CreateDate')}, {_TAGGED('MediaCreateDate')})")} AS t_created,
  {_PRESENT(_TAGGED('Make'))} AS camera_make, {_PRESENT(_TAGGED('Model'))} AS camera_model, {_PRESENT(f"coalesce({_TAGGED('SerialNumber')}, {_TAGGED('InternalSerialNumber')})")} AS camera_serial,
  {_PRESENT(_TAGGED('LensModel'))} AS lens_model, strftime(make_timestamp(CAST(mtime * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS mtime_text FROM a2),
a4 AS (SELECT *, CASE WHEN ext IN {names.IMAGE} THEN 'image' WHEN ext IN {names.RAW} THEN 'raw' WHEN ext IN {names.VIDEO} THEN 'video' ELSE 'other' END AS kind,
  coalesce(t_taken, t_created) AS capture_time, coalesce(t_taken, t_created, mtime_text) AS effective_date,
  CASE WHEN t_taken IS NOT NULL THEN 'exif_taken' WHEN t_created IS NOT NULL THEN 'exif_created' ELSE 'mtime' END AS date_source,
  coalesce(t_taken, t_created) IS NOT NULL AND camera_make IS NOT NULL AND camera_model IS NOT NULL AS has_full_exif,
  md5(encode(text) || unhex(array_to_string(list_transform(range(8), lambda i: substr(printf('%016x', size), CAST(15 - 2 * i AS BIGINT), 2)), ''))) AS quick_hash FROM a3),
f AS (SELECT *, CASE WHEN decode_ok THEN 10000.0::DOUBLE + 5000.0::DOUBLE * CASE WHEN valid_rows IS NULL OR height IS NULL OR height = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(valid_rows AS DOUBLE) / CAST(height AS DOUBLE))) END
    + least(size / 1024.0::DOUBLE, 50000.0::DOUBLE) / 50.0::DOUBLE + CASE WHEN has_full_exif THEN 500.0::DOUBLE ELSE 0.0 END + CASE WHEN capture_time <> '' THEN 200.0::DOUBLE ELSE 0.0 END - CASE WHEN NOT end_ok THEN 1000.0::DOUBLE ELSE 0.0 END
  ELSE size / 1e6::DOUBLE END AS quality_score,
  CASE WHEN count(*) OVER (PARTITION BY quick_hash) > 1 THEN sha256(text) END AS sha256 FROM a4)
"""


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, before any stage: path, size, times, tags, bytes (content)."""
    made = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in _MADE.items()])
    rows = made.selectExpr(*[f"{e} AS {c}" for c, e in _THEN.items()])
    return rows.withColumn("content", F.encode("text", "UTF-8")).withColumn("size", F.octet_length("text").cast("long")).withColumn("kind", names.classify_kind(F.col("relpath")))


def described(files: DataFrame) -> DataFrame:
    """Files with their metadata and quality score."""
    rows = files.withColumn("_m", metadata.resolve(metadata.tags(F.col("tag_json")), F.col("mtime"))).select(*files.columns, "_m.*")
    return rows.withColumn("quality_score", integrity.quality_score(*[F.col(c) for c in ("decode_ok", "valid_rows", "height", "size", "has_full_exif", "capture_time", "end_ok")]))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after all stages: quick hashes, full hashes where those collide, metadata, scores."""
    rows = fingerprints.quick(described(raw_files(spark, sf_dir)))
    shas = fingerprints.full(fingerprints.quick(raw_files(spark, sf_dir).select("file_id", "content", "size"))).select("file_id", "sha256")
    return rows.drop("content", "text").join(shas, "file_id", "left")


#: Pages as files of a tree.
_PAGE = "concat(regexp_replace(url, '^[a-z]+://', ''), CASE WHEN page_id % 97 = 0 THEN '.jpg' WHEN page_id % 3 = 0 THEN '/' ELSE '' END, CASE WHEN page_id % 3 = 0 AND page_id % 97 <> 0 THEN concat('p', CAST(page_id AS STRING), '.html') ELSE '' END)"
_PARTS = "list_filter(string_split(d, '/'), lambda x: x <> '')"
#: DuckDB: ``p`` (files), ``own`` (own counts by directory), ``up`` (each directory with itself and all above it), ``tree``.
TREE_SQL = f"""
p AS (SELECT {_PAGE} AS relpath FROM pages),
own AS (SELECT regexp_replace(regexp_replace(relpath, '[^/]*$', ''), '/$', '') AS d, count(*) AS own_total, count(*) FILTER (regexp_matches(lower(relpath), '\\.({'|'.join(names.EXTENSIONS)})$')) AS own_media FROM p GROUP BY 1),
up AS (SELECT d, own_total, own_media, unnest(list_transform(range(0, len({_PARTS}) + 1), lambda i: array_to_string(({_PARTS})[1:i], '/'))) AS anc FROM own),
tree AS (SELECT anc AS relpath, CAST(sum(CASE WHEN anc = d THEN own_total ELSE 0 END) AS BIGINT) AS own_total, CAST(sum(CASE WHEN anc = d THEN own_media ELSE 0 END) AS BIGINT) AS own_media,
  CAST(sum(own_total) AS BIGINT) AS total_files, CAST(sum(own_media) AS BIGINT) AS media_files, sum(own_total) >= 20 AND sum(own_media) / sum(own_total) < 0.01 AS flagged FROM up GROUP BY anc)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(f"{_PAGE} AS relpath")
