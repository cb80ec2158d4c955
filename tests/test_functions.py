"""Column functions against plain Python."""

import os
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendspan.functions import hashes, integrity, metadata, names


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")


def evaluate(spark, values, function, kind="string"):
    rows = column(spark, values, kind).select("i", function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def safe(s):
    c = re.sub(r"[. ]+$", "", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "-", s or "").strip())
    return re.sub("-+", "-", re.sub(r"\s+", " ", c)).strip("-") or "unknown"


NAMES = ["Canon EOS R5", "a/b\\c", "x: ", "  ..", None, "", "--a--b--", "tab\there", "end. . ", "?"]


def test_safe_filename(spark):
    assert evaluate(spark, NAMES, names.safe_filename) == [safe(x) for x in NAMES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab -./\\:*?\"<>|\t.é"), max_size=12), min_size=20, max_size=40))
def test_safe_filename_any(spark, values):
    assert evaluate(spark, values, names.safe_filename) == [safe(x) for x in values]


def test_format_bytes(spark):
    def shown(n):
        if n < 1024:
            return f"{n} B"
        for unit in ("KB", "MB", "GB", "TB"):
            n /= 1024.0
            if n < 1024:
                return f"{n:.2f} {unit}"
        return f"{n / 1024:.2f} PB"

    values = [0, 1, 1023, 1024, 1152, 1664, 123456, 10**7, 10**10, 10**13, 5 * 10**15]
    assert evaluate(spark, values, names.format_bytes, "long") == [shown(v) for v in values]


def test_kinds(spark):
    paths = ["a/b.JPG", ".jpg", "x.cr2", "y.MOV", "z.txt", "noext", "d.x/f"]
    assert evaluate(spark, paths, names.classify_kind) == ["image", "other", "raw", "video", "other", "other", "other"]
    assert evaluate(spark, paths, names.is_candidate) == [True, True, True, True, False, False, False]


def test_walkable(spark):
    assert evaluate(spark, ["", "a/b", "$x", "a/$y/z", "_replaced", "a/_replaced2", "_other", ".d"], names.walkable) == [True, True, False, False, False, False, True, True]


def test_prefix_exclusion(spark):
    rows = [("keep", "keep"), ("keeper", "keep"), ("keep/x", "keep"), ("a/b", "/a\\b/"), ("a", "a/b")]
    got = spark.createDataFrame(rows, "r string, e string").select(names.excluded_by_prefix(F.col("r"), F.col("e")).alias("x"))
    assert [r["x"] for r in got.collect()] == [True, False, True, True, False]


def test_exif_datetime(spark):
    values = ["2023:08:14 14:23:05", "2023-08-14T14:23:05+02:00", " 2023:13:40 25:61:61.5", "bad", "", None]
    assert evaluate(spark, values, metadata.exif_datetime) == ["2023-08-14 14:23:05", "2023-08-14 14:23:05", "2023-13-40 25:61:61", None, None, None]


def test_metadata_of_odd_json(spark):
    values = ['[{"SerialNumber":123,"Make":" Canon ","DateTimeOriginal":"2020:01:02 03:04:05","Model":"R5"}]', "[]", "broken", None]
    got = evaluate(spark, values, lambda c: metadata.resolve(metadata.tags(c), F.lit(86400.0)))
    assert (got[0]["camera_serial"], got[0]["camera_make"], got[0]["has_full_exif"], got[0]["date_source"]) == ("123", "Canon", True, "exif_taken")
    assert [(x["effective_date"], x["date_source"]) for x in got[1:]] == [("1970-01-02 00:00:00", "mtime")] * 3


def test_device(spark):
    rows = [("Canon", "Canon EOS R5", "1"), ("Canon", "EOS", None), (None, None, None), ("", "", ""), ("NIKON", "nikon d850", "")]
    got = spark.createDataFrame(rows, "k string, m string, s string").select(names.device_slug(F.col("k"), F.col("m"), F.col("s")).alias("d"))
    assert [r["d"] for r in got.collect()] == ["Canon EOS R5-1", "Canon-EOS", "unknown-device", "unknown-device", "nikon d850"]


def test_target_path(spark):
    rows = [("2023-08-14 14:23:05", "exif_taken", "ab" * 32, "x.JPG", 5.0), ("2023-08-14 14:23:05", "mtime", None, "x", 5.0), ("bad", "exif_taken", None, "x.png", 86400.0), (None, None, None, "x.png", 0.0)]
    cols = [F.col(c) for c in ("d", "s", "n", "n", "n", "sha", "p", "m")]
    got = spark.createDataFrame(rows, "d string, s string, sha string, p string, m double").withColumn("n", F.lit(None).cast("string")).select(names.target_path(*cols).alias("t"))
    assert [r["t"] for r in got.collect()] == ["2023-08-14-unknown-device/142305_abababab.jpg", "2023-08-14-s-unknown-device/142305_00000000.bin", "1970-01-02-s-unknown-device/000000_00000000.png", "unknown-date-unknown-device/000000_00000000.png"]


def test_quality_score(spark):
    rows = [(False, 1, 2, 2_000_000, True, "x", True), (True, None, 10, 1024, False, None, None), (True, 5, 10, 0, True, "x", False), (True, 50, 10, 10**12, False, "", True), (None, 5, 10, None, None, None, None)]
    got = spark.createDataFrame(rows, "d boolean, v int, h int, s long, f boolean, c string, e boolean").select(integrity.quality_score(*[F.col(c) for c in "dvhsfce"]).alias("q"))
    assert [round(r["q"], 6) for r in got.collect()] == [2.0, 15000.02, 12200.0, 16000.0, 0.0]


def test_jpeg_end(spark):
    rows = [("a.jpg", b"\xff\xd9"), ("a.JPEG", b"\xd9"), ("a.jpg", b""), ("a.jpg", None), ("a.png", b"\xff\xd9")]
    got = spark.createDataFrame(rows, "p string, t binary").select(integrity.jpeg_end(F.col("p"), F.col("t")).alias("e"))
    assert [r["e"] for r in got.collect()] == [True, False, False, False, None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(-(1 << 63), (1 << 63) - 1)] * 2), min_size=10, max_size=30))
def test_hamming(spark, pairs):
    got = spark.createDataFrame(pairs, "a long, b long").select(hashes.hamming(F.col("a"), F.col("b")).alias("h"), hashes.bucket(F.col("a")).alias("k"))
    assert [(r["h"], r["k"]) for r in got.collect()] == [(((a ^ b) & (2**64 - 1)).bit_count(), (a & (2**64 - 1)) >> 48) for a, b in pairs]


def test_quick_bytes_match_the_reader(spark, tmp_path):
    import xxhash

    from mendspan.sources.content import quick_hash

    for size in (0, 10, 131072, 131073, 300000):
        data = os.urandom(size)
        (tmp_path / "f").write_bytes(data)
        row = spark.createDataFrame([(data, size)], "c binary, s long").select(hashes.quick_bytes(F.col("c"), F.col("s")).alias("q")).first()
        assert xxhash.xxh64_hexdigest(bytes(row["q"])) == quick_hash(str(tmp_path / "f"), size)


def test_pixels():
    dead = np.full((10, 20), 7.0)
    live = dead.copy()
    live[3] = np.arange(20) * 10
    assert hashes.valid_rows(dead) == 0
    assert hashes.valid_rows(live) == 4
    live[8] = live[3]
    assert hashes.valid_rows(live) == 9
    assert hashes.valid_rows(None) is None
    rng = np.random.default_rng(0)
    image = rng.random((64, 64)) * 255
    noisy = image + rng.random((64, 64))
    assert (hashes.perceptual_hash(image) ^ hashes.perceptual_hash(noisy)).bit_count() <= 8
    assert hashes.majority([0b111, 0b110, 0b100]) == 0b110
    assert hashes.majority([]) is None
