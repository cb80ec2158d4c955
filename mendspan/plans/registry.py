"""All queries of the media-library operators, and the same in DuckDB's SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendspan.functions import hashes, integrity, metadata, names
from mendspan.operators import catalog, clusters, directories, fingerprints, organize, report, select
from mendspan.plans.adapters import FILES_SQL, TREE_SQL, described, files, pages, raw_files
from mendspan.session import table, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_F, _T = f"WITH {FILES_SQL} ", f"WITH {TREE_SQL} "


def query(sql: str | None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


# scans and directories


@query(_F + f"SELECT file_id, relpath FROM f WHERE regexp_matches(lower(relpath), '\\.({'|'.join(names.EXTENSIONS)})$')")
def scan_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_files(spark, sf_dir)
    return rows.filter(names.is_candidate(F.col("relpath"))).select("file_id", "relpath")


@query(_F + "SELECT file_id, kind FROM f")
def classify_kind(spark, sf_dir):
    return raw_files(spark, sf_dir).select("file_id", "kind")


@query(_T + "SELECT d AS relpath, own_total, own_media FROM own")
def dir_discover(spark, sf_dir):
    return directories.discover(pages(spark, sf_dir))


def _tree(spark, sf_dir):
    return directories.rollup(directories.discover(pages(spark, sf_dir)))


@query(_T + "SELECT relpath, regexp_extract(relpath, '[^/]*$') AS name, CAST(CASE WHEN relpath = '' THEN 0 ELSE len(string_split(relpath, '/')) END AS INTEGER) AS depth, CASE WHEN relpath <> '' THEN regexp_replace(regexp_replace(relpath, '[^/]*$', ''), '/$', '') END AS parent, own_total, own_media, total_files, media_files, flagged FROM tree")
def dir_rollup(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(_T + "SELECT relpath FROM tree WHERE flagged")
def noise_flag(spark, sf_dir):
    return _tree(spark, sf_dir).filter("flagged").select("relpath")


@query("SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'cache' WHEN 'de' THEN 'system' END AS hint FROM documents GROUP BY lang")
def name_hint(spark, sf_dir):
    named = F.when(F.col("lang") == "en", "Node_Modules").when(F.col("lang") == "de", "AppData").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("hint", names.name_hint(named))


_EXCLUDED = [("blog.tiontion.example.com\\en/",), ("/thther.example.org",), ("none",)]


@query(_T + "SELECT relpath FROM tree WHERE NOT (relpath = 'blog.tiontion.example.com/en' OR starts_with(relpath, 'blog.tiontion.example.com/en/') OR relpath = 'thther.example.org' OR starts_with(relpath, 'thther.example.org/'))")
def include_prefix(spark, sf_dir):
    return directories.include_by_prefix(_tree(spark, sf_dir).select("relpath"), spark.createDataFrame(_EXCLUDED, "excluded string"))


@query(_T + "SELECT relpath FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.relpath <> '' AND length(c.relpath) % 7 = 0 AND (c.relpath = t.relpath OR starts_with(t.relpath, c.relpath || '/')))")
def include_exact(spark, sf_dir):
    dirs = written(_tree(spark, sf_dir).select("relpath"))
    return directories.include_exact(dirs, dirs.filter("length(relpath) % 7 <> 0"))


@query(_T + "SELECT relpath FROM tree WHERE NOT flagged")
def default_checked(spark, sf_dir):
    return directories.default_checked(_tree(spark, sf_dir))


@query(_T + "SELECT relpath FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE length(c.relpath) % 5 = 0 AND (c.relpath = t.relpath OR (c.relpath <> '' AND starts_with(t.relpath, c.relpath || '/'))))")
def resume_dirs(spark, sf_dir):
    dirs = written(_tree(spark, sf_dir).select("relpath"))
    return directories.resume(dirs, dirs.filter("length(relpath) % 5 = 0"))


@query(_T + "SELECT relpath, total_files AS file_count, media_files AS media_count FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE length(c.relpath) % 11 = 3 AND (c.relpath = t.relpath OR t.relpath = '' OR starts_with(c.relpath, t.relpath || '/')))")
def dir_complete(spark, sf_dir):
    tree = written(_tree(spark, sf_dir))
    return directories.complete(tree, tree.filter("length(relpath) % 11 = 3").select("relpath"))


@query(_F + "SELECT file_id FROM f WHERE file_id % 3 <> 0")
def skip_indexed(spark, sf_dir):
    rows = raw_files(spark, sf_dir).select("file_id", "drive_id", "relpath")
    return rows.join(rows.filter("file_id % 3 = 0").select("drive_id", "relpath"), ["drive_id", "relpath"], "left_anti").select("file_id")


@query(
    _F
    + """, n AS (SELECT file_id, drive_id, concat('/mnt/', CAST(file_id % 500 AS STRING)) AS path, concat('r', CAST(file_id % 300 AS STRING)) AS relpath FROM f),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id) AS k FROM n) WHERE k = 1 AND file_id % 500 >= 40 AND NOT (drive_id = 3 AND file_id % 300 < 90))
SELECT file_id, path FROM (SELECT *, row_number() OVER (PARTITION BY drive_id, relpath ORDER BY path) AS j FROM o) WHERE j = 1"""
)
def insert_ignore(spark, sf_dir):
    place = lambda m, p: F.concat(F.lit(p), (F.col("file_id") % m).cast("string"))
    new = raw_files(spark, sf_dir).select("file_id", "drive_id", place(500, "/mnt/").alias("path"), place(300, "r").alias("relpath"))
    by_path = spark.range(40).select(F.concat(F.lit("/mnt/"), F.col("id").cast("string")).alias("path"), F.lit(-1).cast("long").alias("drive_id"), F.lit("-").alias("relpath"))
    by_place = spark.range(90).select(F.concat(F.lit("/old/"), F.col("id").cast("string")).alias("path"), F.lit(3).cast("long").alias("drive_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("relpath"))
    return catalog.insert_ignore(by_path.unionByName(by_place), new).select("file_id", "path")


@query(
    """WITH o AS (SELECT concat('v', CAST(s_suppkey AS STRING)) AS volume_serial, s_name AS label, concat('/d', CAST(s_nationkey AS STRING)) AS source_root, 't1' AS first_seen, 't1' AS last_seen, s_suppkey % 2 = 0 AS online FROM supplier),
s AS (SELECT concat('v', CAST(s_suppkey + 30 AS STRING)) AS volume_serial, CASE WHEN s_suppkey % 3 = 0 THEN 'new' END AS label, CASE WHEN s_suppkey % 4 = 0 THEN '/new' END AS source_root FROM supplier)
SELECT volume_serial, coalesce(s.label, o.label) AS label, coalesce(s.source_root, o.source_root) AS source_root, coalesce(first_seen, 't2') AS first_seen, CASE WHEN s.volume_serial IS NOT NULL THEN 't2' ELSE last_seen END AS last_seen, s.volume_serial IS NOT NULL OR coalesce(online, true) AS online FROM o FULL JOIN s USING (volume_serial)"""
)
def drive_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.selectExpr("concat('v', CAST(s_suppkey AS STRING)) AS volume_serial", "s_name AS label", "concat('/d', CAST(s_nationkey AS STRING)) AS source_root", "'t1' AS first_seen", "'t1' AS last_seen", "s_suppkey % 2 = 0 AS online")
    seen = s.selectExpr("concat('v', CAST(s_suppkey + 30 AS STRING)) AS volume_serial", "CASE WHEN s_suppkey % 3 = 0 THEN 'new' END AS label", "CASE WHEN s_suppkey % 4 = 0 THEN '/new' END AS source_root")
    return catalog.upsert_drives(old, seen, F.lit("t2"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def ledger_upsert(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query(_F + "SELECT file_id, size, CASE WHEN file_id % 2 = 0 THEN 'patched' ELSE error END AS error FROM f")
def row_patch(spark, sf_dir):
    rows = raw_files(spark, sf_dir).select("file_id", "size", "error")
    return catalog.patch(rows, rows.filter("file_id % 2 = 0").select("file_id", F.lit("patched").alias("error")), "file_id")


# fingerprints


@query(_F + "SELECT file_id, quick_hash FROM f")
def quick_fingerprint(spark, sf_dir):
    return fingerprints.quick(raw_files(spark, sf_dir)).select("file_id", "quick_hash")


@query(None)
def quick_fingerprint_xxh64(spark, sf_dir):
    return raw_files(spark, sf_dir).select("file_id", hashes.xxh64(hashes.quick_bytes(F.col("content"), F.col("size"))).alias("quick_hash"))


def _quick(spark, sf_dir):
    return fingerprints.quick(raw_files(spark, sf_dir).select("file_id", "content", "size"))


@query(_F + "SELECT quick_hash, count(*) AS n FROM f GROUP BY quick_hash HAVING count(*) > 1")
def collision_groups(spark, sf_dir):
    return fingerprints.collision_groups(_quick(spark, sf_dir))


@query(_F + "SELECT file_id FROM f WHERE sha256 IS NOT NULL")
def collision_files(spark, sf_dir):
    return fingerprints.colliding(_quick(spark, sf_dir).select("file_id", "quick_hash")).select("file_id")


@query(_F + "SELECT file_id FROM f WHERE sha256 IS NULL")
def non_collision_mark(spark, sf_dir):
    return fingerprints.not_colliding(_quick(spark, sf_dir).select("file_id", "quick_hash")).select("file_id")


@query(_F + "SELECT file_id, sha256 FROM f WHERE sha256 IS NOT NULL")
def full_hash(spark, sf_dir):
    return fingerprints.full(_quick(spark, sf_dir)).select("file_id", "sha256")


@query(_F + "SELECT file_id FROM f WHERE last_stage_done = 1")
def stage_markers(spark, sf_dir):
    return catalog.pending(raw_files(spark, sf_dir), 2).select("file_id")


@query(_F + "SELECT file_id, path FROM f WHERE last_stage_done = 2 ORDER BY path LIMIT 40")
def analyze_limit(spark, sf_dir):
    return catalog.pending(raw_files(spark, sf_dir), 3, 40).select("file_id", "path")


# integrity and pixels


@query(_F + "SELECT file_id, CASE WHEN ext IN ('jpg', 'jpeg') THEN file_id % 3 = 0 END AS end_ok FROM f")
def jpeg_eoi(spark, sf_dir):
    tail = F.when(F.col("file_id") % 3 == 0, F.unhex(F.lit("00FFD9"))).when(F.col("file_id") % 3 == 1, F.unhex(F.lit("FFD900")))
    return raw_files(spark, sf_dir).select("file_id", integrity.jpeg_end(F.col("relpath"), tail).alias("end_ok"))


@query("SELECT vec_id, CAST(coalesce(max(CASE WHEN v > 0.015 THEN r + 1 END), 0) AS BIGINT) AS valid_rows FROM (SELECT vec_id, r, var_pop(x) AS v FROM (SELECT vec_id, unnest(range(64)) // 8 AS r, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id, r) GROUP BY vec_id")
def row_variance(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    rows = cells.groupBy("vec_id", F.floor(F.col("at") / 8).alias("row")).agg(F.var_pop("x").alias("v"))
    return rows.groupBy("vec_id").agg(F.coalesce(F.max(F.when(F.col("v") > 0.015, F.col("row") + 1)), F.lit(0)).cast("long").alias("valid_rows"))


@query(_F + "SELECT file_id, round(quality_score, 6) AS quality_score FROM f")
def quality_score(spark, sf_dir):
    return described(raw_files(spark, sf_dir)).select("file_id", F.round("quality_score", 6).alias("quality_score"))


def _packed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", hashes.pack_bits(F.transform("embedding", lambda x: x > 0)).alias("hash"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def bit_pack(spark, sf_dir):
    return _packed(spark, sf_dir).select("vec_id", F.array_join(F.transform(hashes.bits_of(F.col("hash")), lambda b: b.cast("string")), "").alias("bits"))


@query("SELECT label, place, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) > count(*) / 2.0 AS bit FROM (SELECT label, CAST(unnest(range(64)) AS INTEGER) AS place, unnest(embedding) AS x FROM embeddings) GROUP BY label, place")
def bit_majority(spark, sf_dir):
    bits = _packed(spark, sf_dir).select("label", F.posexplode(hashes.bits_of(F.col("hash"))).alias("place", "bit"))
    return bits.groupBy("label", "place").agg((F.sum("bit") > F.count("*") / 2).alias("bit"))


# clusters

_REPS = "r AS (SELECT phash, coalesce(dhash, phash) AS dh, min(file_id) AS rep FROM f GROUP BY 1, 2)"
_NEAR = "SELECT x.rep AS a, y.rep AS b FROM r x JOIN r y ON (x.phash >> 48) & 65535 = (y.phash >> 48) & 65535 AND x.rep < y.rep AND (bit_count(xor(x.phash, y.phash)) <= 8 OR bit_count(xor(x.dh, y.dh)) <= 8)"
_CLUSTERS = f"""WITH RECURSIVE {FILES_SQL}, {_REPS},
links AS ({_NEAR} UNION SELECT rep, file_id FROM f JOIN r ON f.phash = r.phash AND coalesce(f.dhash, f.phash) = dh UNION SELECT min(file_id) OVER (PARTITION BY sha256), file_id FROM f WHERE sha256 IS NOT NULL),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT file_id, file_id AS root FROM f UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.file_id),
m AS (SELECT file_id, min(root) AS cluster_id FROM reach GROUP BY file_id),
c AS (SELECT f.*, m.cluster_id FROM f JOIN m ON f.file_id = m.file_id),
w AS (SELECT cluster_id, file_id AS winner_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(quality_score, 0) DESC, coalesce(size, 0) DESC, has_full_exif DESC, file_id) AS k FROM c) WHERE k = 1),
dn AS (SELECT cluster_id, file_id AS donor_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY has_full_exif DESC, (coalesce(camera_serial, '') <> '')::INT + (coalesce(lens_model, '') <> '')::INT DESC, CAST(trunc(coalesce(quality_score, 0)) AS BIGINT) DESC, file_id) AS k FROM c) WHERE k = 1),
dt AS (SELECT cluster_id, effective_date, date_source AS effective_date_source FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE date_source WHEN 'exif_taken' THEN 3 WHEN 'exif_created' THEN 2 ELSE 1 END DESC, file_id) AS k FROM c) WHERE k = 1),
s AS (SELECT cluster_id, count(*) AS member_count, arg_min(kind, file_id) AS kind FROM c GROUP BY cluster_id)
"""


def _clustered(spark, sf_dir):
    rows = written(files(spark, sf_dir))
    return written(rows.join(clusters.assign(rows), "file_id"))


@query(_F + ", " + _REPS + " " + _NEAR)
def hamming_pairs(spark, sf_dir):
    return clusters.near_pairs(raw_files(spark, sf_dir).select("file_id", "phash", "dhash"))


@query(_F + "SELECT a, file_id AS b FROM (SELECT file_id, min(file_id) OVER (PARTITION BY sha256) AS a FROM f WHERE sha256 IS NOT NULL) WHERE file_id > a")
def exact_clusters(spark, sf_dir):
    return clusters.exact_links(fingerprints.full(_quick(spark, sf_dir)).select("file_id", "sha256"))


@query(_CLUSTERS + "SELECT file_id, cluster_id FROM m")
def near_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).select("file_id", "cluster_id")


@query(_CLUSTERS + "SELECT cluster_id, member_count, kind FROM s")
def cluster_summary(spark, sf_dir):
    return clusters.summary(_clustered(spark, sf_dir))


@query(_CLUSTERS + "SELECT cluster_id FROM s WHERE member_count = 1")
def singletons(spark, sf_dir):
    return clusters.singletons(_clustered(spark, sf_dir).select("file_id", "cluster_id")).select("cluster_id")


@query(_CLUSTERS + "SELECT cluster_id, winner_id FROM w")
def winner(spark, sf_dir):
    return select.winners(_clustered(spark, sf_dir))


@query(_CLUSTERS + "SELECT cluster_id, donor_id FROM dn")
def donor(spark, sf_dir):
    return select.donors(_clustered(spark, sf_dir))


@query(_CLUSTERS + "SELECT cluster_id, effective_date, effective_date_source FROM dt")
def cluster_date(spark, sf_dir):
    return select.dates(_clustered(spark, sf_dir))


@query("SELECT l_orderkey AS cluster_id, l_linenumber AS winner_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def winner_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return select.winners(rows.select(F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("file_id"), F.col("l_extendedprice").alias("quality_score"), F.col("l_quantity").alias("size"), F.lit(None).cast("boolean").alias("has_full_exif")))


# metadata


@query(_F + "SELECT file_id, t_taken AS taken FROM f WHERE json_valid(tag_json) AND tag_json <> '[]'")
def exif_datetime(spark, sf_dir):
    rows = raw_files(spark, sf_dir).filter("tag_json <> 'broken' AND tag_json <> '[]'")
    return rows.select("file_id", metadata.exif_datetime(F.col("taken")).alias("taken"))


@query(_F + "SELECT file_id, mtime_text FROM f")
def mtime_iso(spark, sf_dir):
    return raw_files(spark, sf_dir).select("file_id", metadata.mtime_iso(F.col("mtime")).alias("mtime_text"))


@query(_F + "SELECT file_id, CASE WHEN json_valid(tag_json) THEN json_extract_string(tag_json, '$[0].Make') END AS make, CASE WHEN json_valid(tag_json) THEN json_extract_string(tag_json, '$[0].SerialNumber') END AS serial FROM f")
def json_tags(spark, sf_dir):
    t = metadata.tags(F.col("tag_json"))
    return raw_files(spark, sf_dir).select("file_id", t["Make"].alias("make"), t["SerialNumber"].alias("serial"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_META = "capture_time, camera_make, camera_model, camera_serial, lens_model, has_full_exif, effective_date, date_source"


@query(_F + f"SELECT file_id, {_META} FROM f")
def metadata_resolve(spark, sf_dir):
    return described(raw_files(spark, sf_dir)).select("file_id", *_META.split(", "))


@query(_F + "SELECT file_id, CASE date_source WHEN 'exif_taken' THEN 3 WHEN 'exif_created' THEN 2 ELSE 1 END AS rank, CASE WHEN date_source = 'exif_taken' THEN date_source ELSE 'exif_created' END AS better FROM f")
def date_rank(spark, sf_dir):
    rows = described(raw_files(spark, sf_dir))
    return rows.select("file_id", metadata.source_rank(F.col("date_source")).alias("rank"), metadata.better_source(F.lit("exif_created"), F.col("date_source")).alias("better"))


_SAFE = lambda c: rf"""coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '^\s+|\s+$', '', 'g'), '[. ]+$', ''), '\s+', ' ', 'g'), '-+', '-', 'g'), '-'), ''), 'unknown')"""


@query(_F + f"SELECT file_id, {_SAFE('model')} AS model, {_SAFE('make')} AS make, {_SAFE('left(text, 60)')} AS opening FROM f")
def safe_filename(spark, sf_dir):
    safe = lambda c, name: names.safe_filename(c).alias(name)
    return raw_files(spark, sf_dir).select("file_id", safe(F.col("model"), "model"), safe(F.col("make"), "make"), safe(F.left("text", F.lit(60)), "opening"))


@query(_F + "SELECT file_id, CASE WHEN n < 1024 THEN concat(CAST(n AS STRING), ' B') WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS shown FROM (SELECT file_id, size * (1 + (file_id % 3) * (file_id % 997) * 700) AS n FROM f)")
def format_bytes(spark, sf_dir):
    n = F.col("size") * (1 + (F.col("file_id") % 3) * (F.col("file_id") % 997) * 700)
    return raw_files(spark, sf_dir).select("file_id", names.format_bytes(n).alias("shown"))


_K, _M = f"CASE WHEN camera_make <> '' THEN {_SAFE('camera_make')} END", f"CASE WHEN camera_model <> '' THEN {_SAFE('camera_model')} END"
_DEVICE = f"coalesce(nullif(concat_ws('-', CASE WHEN starts_with(lower({_M}), lower({_K})) THEN NULL ELSE {_K} END, {_M}, CASE WHEN camera_serial <> '' THEN {_SAFE('camera_serial')} END), ''), 'unknown-device')"


@query(_F + f"SELECT file_id, {_DEVICE} AS device FROM f")
def device_slug(spark, sf_dir):
    return described(raw_files(spark, sf_dir)).select("file_id", names.device_slug(F.col("camera_make"), F.col("camera_model"), F.col("camera_serial")).alias("device"))


_WHEN = "coalesce(try_strptime(effective_date, '%Y-%m-%d %H:%M:%S'), try_strptime(effective_date, '%Y-%m-%dT%H:%M:%S'))"
_AT = f"coalesce({_WHEN}, CASE WHEN mtime <> 0 THEN make_timestamp(CAST(mtime * 1000000 AS BIGINT)) END)"
_TARGET = f"concat(CASE WHEN {_AT} IS NULL THEN 'unknown-date' ELSE concat(strftime({_AT}, '%Y-%m-%d'), CASE WHEN {_WHEN} IS NULL OR date_source = 'mtime' THEN '-s' ELSE '' END) END, '-', {_DEVICE}, '/', coalesce(strftime({_AT}, '%H%M%S'), '000000'), '_', left(coalesce(sha256, '00000000'), 8), '.', coalesce(nullif(ext, ''), 'bin'))"


@query(_F + f"SELECT file_id, {_TARGET} AS target FROM f")
def target_path(spark, sf_dir):
    cols = [F.col(c) for c in ("effective_date", "date_source", "camera_make", "camera_model", "camera_serial", "sha256", "path", "mtime")]
    return files(spark, sf_dir).select("file_id", names.target_path(*cols).alias("target"))


# layout and reports

_PLAN = (
    _CLUSTERS
    + f""", pl AS (SELECT cluster_id, winner_id, donor_id, effective_date_source, winner_path, donor_path, quality_score, {_TARGET} AS target_path FROM (
  SELECT w.cluster_id, w.winner_id, dn.donor_id, dt.effective_date, dt.effective_date_source, dt.effective_date_source AS date_source, wf.path AS winner_path, wf.mtime, wf.sha256, wf.ext, wf.quality_score, df.path AS donor_path, df.camera_make, df.camera_model, df.camera_serial
  FROM w JOIN dn ON w.cluster_id = dn.cluster_id JOIN dt ON dt.cluster_id = w.cluster_id JOIN f wf ON wf.file_id = w.winner_id JOIN f df ON df.file_id = dn.donor_id)),
lg AS (SELECT cluster_id, CASE WHEN cluster_id % 4 = 1 THEN -winner_id - 1 ELSE winner_id END AS organized_from_id, CASE WHEN cluster_id % 4 = 2 THEN 'old/' || target_path ELSE target_path END AS target_path FROM pl WHERE cluster_id % 2 = 0 OR cluster_id % 4 = 1),
ac AS (SELECT pl.*, lg.target_path AS current_target, CASE WHEN winner_id % 6 = 0 THEN 'pending' WHEN lg.target_path = pl.target_path AND organized_from_id % 5 <> 0 THEN 'skip' WHEN lg.target_path <> pl.target_path THEN 'replace' ELSE 'write' END AS action FROM pl LEFT JOIN lg ON pl.winner_id = lg.organized_from_id)
"""
)


def _plan(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    return written(organize.plan(select.choose(rows), rows)), rows


def _actions(spark, sf_dir):
    planned, rows = _plan(spark, sf_dir)
    ledger = planned.filter("cluster_id % 2 = 0 OR cluster_id % 4 = 1").selectExpr("cluster_id", "CASE WHEN cluster_id % 4 = 1 THEN -winner_id - 1 ELSE winner_id END AS organized_from_id", "CASE WHEN cluster_id % 4 = 2 THEN concat('old/', target_path) ELSE target_path END AS target_path")
    existing = ledger.filter("organized_from_id % 5 <> 0").select("target_path")
    return organize.difference(planned, ledger, rows.filter("file_id % 6 <> 0").select("path"), existing)


@query(_PLAN + "SELECT cluster_id, winner_path, donor_path, target_path FROM pl")
def organize_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("cluster_id", "winner_path", "donor_path", "target_path")


@query(_PLAN + "SELECT cluster_id FROM pl WHERE winner_id % 6 = 0")
def offline_pending(spark, sf_dir):
    planned, rows = _plan(spark, sf_dir)
    return organize.offline(planned, rows.filter("file_id % 6 <> 0").select("path")).select("cluster_id")


@query(_PLAN + "SELECT cluster_id, action, target_path, current_target FROM ac")
def organize_diff(spark, sf_dir):
    return _actions(spark, sf_dir).select("cluster_id", "action", "target_path", "current_target")


@query(_PLAN + "SELECT cluster_id, winner_path, coalesce(donor_path, '') AS donor_path, target_path, round(quality_score, 6) AS quality_score, effective_date_source AS date_source, '2024-01-01T00:00:00Z' AS organized_at FROM ac WHERE action IN ('write', 'replace')")
def manifest(spark, sf_dir):
    return organize.manifest(_actions(spark, sf_dir), F.lit("2024-01-01T00:00:00Z")).withColumn("quality_score", F.round("quality_score", 6))


@query(_PLAN + "SELECT count(*) FILTER (action IN ('write', 'replace') AND error IS NULL) AS written, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'replace' AND error IS NULL) AS replaced, count(*) FILTER (action = 'pending') AS pending_offline, count(error) AS errors, count(*) AS total_clusters FROM (SELECT *, CASE WHEN action IN ('write', 'replace') AND winner_id % 7 = 0 THEN 'organize: unreadable' END AS error FROM ac)")
def organize_totals(spark, sf_dir):
    failed = F.col("action").isin("write", "replace") & (F.col("winner_id") % 7 == 0)
    return organize.totals(_actions(spark, sf_dir).withColumn("error", F.when(failed, "organize: unreadable")))


@query(_PLAN + "SELECT cluster_id, CASE WHEN k = 1 THEN target_path ELSE concat(regexp_replace(target_path, '\\.[^.]*$', ''), '_', CAST(k - 1 AS STRING), regexp_extract(target_path, '\\.[^.]*$')) END AS target_path FROM (SELECT cluster_id, target_path, row_number() OVER (PARTITION BY target_path ORDER BY cluster_id) AS k FROM pl)")
def target_clashes(spark, sf_dir):
    return organize.without_clashes(_plan(spark, sf_dir)[0]).select("cluster_id", "target_path")


@query(_CLUSTERS + "SELECT count(*) AS total_files, count(*) FILTER (last_stage_done >= 0) AS scanned, count(*) FILTER (last_stage_done >= 1) AS quickhashed, count(*) FILTER (last_stage_done >= 2) AS fullhashed, count(*) FILTER (last_stage_done >= 3) AS analyzed, count(error) AS errors, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, (SELECT count(*) FROM w) AS clusters, (SELECT count(winner_id) FROM w) AS winners FROM f")
def status(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    return report.status(rows, select.winners(rows))


@query("SELECT s_suppkey AS id, s_name AS volume_serial, s_acctbal AS first_seen FROM supplier ORDER BY s_acctbal, s_name")
def drives_list(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return report.drives(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("volume_serial"), F.col("s_acctbal").alias("first_seen")))


@query(_CLUSTERS + "SELECT s.cluster_id, member_count, effective_date, concat('#', CAST(s.cluster_id AS STRING), ' · ', coalesce(effective_date, 'unknown date'), ' · ', CAST(member_count AS STRING), ' copies', CASE WHEN effective_date_source = 'mtime' THEN ' (save date)' ELSE '' END) AS label FROM s JOIN dt ON s.cluster_id = dt.cluster_id WHERE member_count > 1 ORDER BY member_count DESC, effective_date DESC NULLS LAST, s.cluster_id LIMIT 500")
def top_clusters(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    return report.top_clusters(clusters.summary(rows).join(select.dates(rows), "cluster_id")).select("cluster_id", "member_count", "effective_date", "label")


@query(_CLUSTERS + "SELECT c.cluster_id, file_id, concat(CASE WHEN file_id = winner_id THEN '★ ' ELSE '' END, regexp_extract(path, '[^/]*$')) AS shown, CAST(round_even(coalesce(quality_score, 0), 0) AS BIGINT) AS score, row_number() OVER (PARTITION BY c.cluster_id ORDER BY coalesce(quality_score, 0) DESC, file_id) AS nth, CASE WHEN decode_ok IS NULL THEN '?' WHEN decode_ok THEN 'ok' ELSE 'fail' END AS decode FROM c JOIN w ON c.cluster_id = w.cluster_id")
def cluster_members(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    chosen = select.winners(rows).select(F.col("winner_id").alias("file_id"), F.lit(True).alias("is_winner"))
    by_score = Window.partitionBy("cluster_id").orderBy(F.coalesce("quality_score", F.lit(0.0)).desc(), "file_id")
    nth = rows.select("file_id", F.row_number().over(by_score).cast("long").alias("nth"))
    shown = report.members(rows.join(chosen, "file_id", "left")).join(nth, "file_id")
    return shown.select("cluster_id", "file_id", "shown", F.col("score_text").cast("long").alias("score"), "nth", "decode")


@query(_F + f"SELECT file_id, path, size, kind, quick_hash, {_META} FROM f WHERE file_id = 42")
def file_detail(spark, sf_dir):
    return report.detail(fingerprints.quick(described(raw_files(spark, sf_dir))), 42).select("file_id", "path", "size", "kind", "quick_hash", *_META.split(", "))


@query(_T + "SELECT row_number() OVER (ORDER BY string_split(relpath, '/')) AS nth, concat(repeat('  ', CAST(CASE WHEN relpath = '' THEN 0 ELSE len(string_split(relpath, '/')) END AS BIGINT)), CASE WHEN relpath = '' THEN '/' ELSE regexp_extract(relpath, '[^/]*$') END, '  (', CAST(media_files AS STRING), '/', CAST(total_files AS STRING), ' media)', CASE WHEN flagged THEN ' [noise]' ELSE '' END) AS line FROM tree")
def tree_lines(spark, sf_dir):
    lines = directories.print_tree(_tree(spark, sf_dir))
    return lines.select(F.row_number().over(Window.orderBy("position")).cast("long").alias("nth"), "line")
