"""Operators on small tables, and the library end to end on generated images."""

import os

import pytest
from pyspark.sql import functions as F

from mendspan.cli import cores, is_prerelease, main, memory, parser
from mendspan.operators import catalog, clusters, directories, organize, select
from mendspan.operators.graph import connected_components
from mendspan.plans.library import Library
from mendspan.sources.store import Store

TREE = "relpath string, own_total long, own_media long"


def tree(spark, rows):
    return {r["relpath"]: r for r in directories.rollup(spark.createDataFrame(rows, TREE)).collect()}


def test_rollup_and_noise(spark):
    got = tree(spark, [("", 2, 0), ("trip", 7, 6), ("trip/day1", 11, 11), ("cache/tiles", 300, 2)])
    assert [(got[x]["total_files"], got[x]["media_files"], got[x]["flagged"]) for x in ("", "trip", "cache")] == [(320, 19, False), (18, 17, False), (300, 2, True)]
    for n, media, flag in ((1, 0, False), (directories.LEAST_FILES - 1, 0, False), (directories.LEAST_FILES, 0, True), (250, 2, True), (250, 3, False)):
        assert tree(spark, [("d", n, media)])["d"]["flagged"] is flag


def test_missing_parents_and_repeats(spark):
    got = tree(spark, [("a/b/c", 1, 1), ("a/b/c", 2, 0)])
    assert (got["a"]["own_total"], got["a"]["total_files"], got[""]["total_files"]) == (0, 3, 3)


def test_default_selection(spark):
    rows = directories.rollup(spark.createDataFrame([("", 1, 1), ("work/logs", 45, 0), ("work/scans", 9, 8), ("work/scans/old", 3, 3)], TREE))
    assert {r[0] for r in directories.default_checked(rows).collect()} == {"", "work", "work/scans", "work/scans/old"}
    assert directories.default_checked(rows, skip_noise=False).count() == 5


def names(df):
    return {r["relpath"] for r in df.collect()}


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "relpath string")


def test_include_and_resume(spark):
    dirs = paths(spark, "", "photos", "photos/2024", "photos/raw", "junk", "junk/x")
    assert names(directories.include_exact(dirs, paths(spark, "photos", "photos/2024", "junk/x"))) == {"", "photos", "photos/2024"}
    assert names(directories.include_by_prefix(dirs, spark.createDataFrame([("photos",)], "excluded string"))) == {"", "junk", "junk/x"}
    assert names(directories.resume(dirs, paths(spark, "junk", ""))) == {"photos", "photos/2024", "photos/raw"}


def test_completion_stops_at_pruned(spark):
    rows = directories.rollup(spark.createDataFrame([("", 0, 0), ("a", 1, 1), ("a/b/c", 1, 1), ("d", 1, 1)], TREE))
    assert names(directories.complete(rows, paths(spark, "a/b/c"))) == {"d"}


def test_foreign_key(spark):
    known = spark.createDataFrame([(1,)], "id long")
    catalog.check_foreign_key(spark.createDataFrame([(1,)], "drive_id long"), "drive_id", known, "id")
    with pytest.raises(ValueError, match="999"):
        catalog.check_foreign_key(spark.createDataFrame([(999,)], "drive_id long"), "drive_id", known, "id")


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 50)], [(i, (i + 1) % 40) for i in range(40)], [(5, 9), (9, 7), (1, 2)], []])
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((x, find(x)) for x in root)


FILES = "file_id long, cluster_id long, quality_score double, size long, has_full_exif boolean, camera_serial string, lens_model string, effective_date string, date_source string"


def test_selection_rules(spark):
    rows = [
        (3, 1, 10.0, 5, True, None, None, "d3", "exif_created"),
        (1, 1, 10.0, 5, True, None, None, "d1", "exif_created"),
        (2, 1, None, 9, None, "s", "l", "d2", "mtime"),
        (7, 2, None, None, None, None, None, None, "exif_taken"),
        (8, 2, None, None, None, None, None, "x", None),
        (9, 3, 5.9, 1, False, "s", None, "m", "mtime"),
        (10, 3, 5.2, 2, False, "", "l", "n", "mtime"),
    ]
    got = {r["cluster_id"]: r for r in select.choose(spark.createDataFrame(rows, FILES)).collect()}
    assert [(got[c]["winner_id"], got[c]["donor_id"], got[c]["effective_date"], got[c]["effective_date_source"]) for c in (1, 2, 3)] == [(1, 1, "d1", "exif_created"), (7, 7, None, None), (9, 9, "m", "mtime")]


def test_near_pairs(spark):
    base = 0x7ABC_0000_0000_0000
    rows = [(1, base, 0), (2, base | 0xFF, -1), (3, base | 0x1FF, -1), (4, base ^ (1 << 62), 0), (5, base, None), (6, None, None), (7, base, 0)]
    files = spark.createDataFrame([(*r, None) for r in rows], "file_id long, phash long, dhash long, sha256 string")
    assert sorted(map(tuple, clusters.near_pairs(files).collect())) == [(1, 2), (1, 5), (2, 3), (2, 5)]
    got = {r["file_id"]: r["cluster_id"] for r in clusters.assign(files).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 1}


def test_clashes(spark):
    rows = spark.createDataFrame([(2, "a/x.jpg"), (1, "a/x.jpg"), (3, "a/y.jpg")], "cluster_id long, target_path string")
    assert sorted(map(tuple, organize.without_clashes(rows).select("cluster_id", "target_path").collect())) == [(1, "a/x.jpg"), (2, "a/x_1.jpg"), (3, "a/y.jpg")]


def image(spark, path, seed, kind="jpg"):
    """A textured image, written by Java."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(64, 48, 1)
    rng = jvm.java.util.Random(seed)
    for x in range(0, 64, 8):
        for y in range(0, 48, 8):
            colour = rng.nextInt(1 << 24)
            for dx in range(8):
                for dy in range(8):
                    picture.setRGB(x + dx, y + dy, colour)
    assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(path)))


@pytest.fixture
def album(spark, tmp_path):
    root = tmp_path / "album"
    (root / "one").mkdir(parents=True)
    (root / "$RECYCLE").mkdir()
    (root / "junk/deep").mkdir(parents=True)
    image(spark, root / "one/a.jpg", 1)
    (root / "one/b.jpg").write_bytes((root / "one/a.jpg").read_bytes())
    (root / "one/c.jpg").write_bytes((root / "one/a.jpg").read_bytes()[:-50])
    image(spark, root / "other.jpg", 2)
    (root / "one/.hidden.jpg").write_bytes(b"")
    (root / "$RECYCLE/x.jpg").write_bytes(b"x")
    for i in range(30):
        (root / f"junk/deep/f{i}.txt").write_text("x")
    for p in root.rglob("*.jpg"):
        os.utime(p, (1692022980, 1692022980))
    return root


def test_library(spark, album, tmp_path, capsys):
    db, out = str(tmp_path / "db"), tmp_path / "out"
    assert main(["--db", db, "--log-level", "ERROR", "scan", "--source", str(album), "--list-only"], spark) == 0
    shown = capsys.readouterr().out
    assert "one" in shown
    assert "junk  (0/30 media) [noise]" in shown
    library = Library(Store(spark, db))
    assert library.store.read("files").count() == 0
    assert library.scan(str(album), exclude=("junk",))["inserted"] == 5
    assert {r["relpath"] for r in library.store.read("scanned_dirs").collect()} == {"one"}
    assert library.scan(str(album), exclude=("junk",))["inserted"] == 0
    image(spark, album / "one/new.jpg", 3)
    assert library.scan(str(album))["inserted"] == 0
    assert library.scan(str(album), force=True)["inserted"] == 1
    (album / "one/new.jpg").unlink()
    result = library.run_all(str(album), str(out))
    assert result["quickhash"]["total"] == 6
    assert result["quickhash"]["errors"] == 1
    files = {r["relpath"]: r for r in library.files().collect()}
    assert files["one/a.jpg"]["sha256"] == files["one/b.jpg"]["sha256"]
    assert files["one/c.jpg"]["sha256"] is None
    assert files["one/a.jpg"]["decode_ok"]
    assert files["one/a.jpg"]["end_ok"]
    assert files["one/c.jpg"]["end_ok"] is False
    assert not files["one/.hidden.jpg"]["decode_ok"]
    members = {r["file_id"]: r["cluster_id"] for r in library.store.read("members").collect()}
    same = {members[files[f"one/{x}.jpg"]["file_id"]] for x in "abc"}
    assert len(same) == 1
    assert members[files["other.jpg"]["file_id"]] not in same
    written = sorted(str(p.relative_to(out)) for p in out.rglob("*.jpg"))
    assert len(written) == result["organize"]["written"]
    assert any(x.startswith("2023-08-14-s-unknown-device/142300_") for x in written)
    again = library.organize(str(out))
    assert again["written"] == 0
    assert again["skipped"] == result["organize"]["written"]
    told = library.status()
    assert (told["total_files"], told["errors"], told["fullhashed"]) == (6, 1, 6)
    # an output that was deleted is written again, a winner that is gone is pending
    (out / written[0]).unlink()
    winners = {r["target_path"]: r["organized_from_id"] for r in library.store.read("ledger").collect()}
    paths = {r["file_id"]: r["path"] for r in library.files().collect()}
    assert library.organize(str(out), dry_run=True)["written"] == 1
    assert not (out / written[0]).exists()
    assert library.organize(str(out), dry_run=True)["pending_offline"] == 1
    os.rename(paths[winners[written[0]]], str(tmp_path / "moved"))
    assert library.organize(str(out), dry_run=True)["pending_offline"] == 2
    os.rename(str(tmp_path / "moved"), paths[winners[written[0]]])
    image(spark, album.parent / "second.jpg", 9)
    second = album.parent / "elsewhere"
    (second / "one").mkdir(parents=True)
    os.rename(str(album.parent / "second.jpg"), str(second / "one/a.jpg"))
    assert library.scan(str(second))["inserted"] == 1
    library.store.set_meta("k", "1")
    library.store.set_meta("k", "2")
    assert (library.store.get_meta("k"), library.store.get_meta("none", "d")) == ("2", "d")


def test_organize_survives_a_failing_file(spark, tmp_path):
    good = tmp_path / "a.jpg"
    good.write_bytes(b"a")
    rows = [(1, "write", str(good), None, "x/a.jpg", None), (2, "write", str(tmp_path / "gone.jpg"), None, "x/b.jpg", None), (3, "replace", str(good), None, "x/c.jpg", "x/old.jpg"), (4, "skip", str(good), None, "x/d.jpg", None)]
    (tmp_path / "out/x").mkdir(parents=True)
    (tmp_path / "out/x/old.jpg").write_bytes(b"o")
    actions = spark.createDataFrame(rows, "winner_id long, action string, winner_path string, donor_path string, target_path string, current_target string")
    done = {r["winner_id"]: r["error"] for r in organize.copy_out(actions, str(tmp_path / "out"), "2024-01-01").collect()}
    assert [done[1], done[3]] == [None, None]
    assert "gone.jpg" in done[2]
    assert (tmp_path / "out/_replaced/2024-01-01/old.jpg").exists()


def test_ledger_is_kept_by_winner(spark):
    planned = spark.createDataFrame([(10, 5, "p", "t/a.jpg"), (20, 6, "q", "t/b.jpg"), (30, 7, "r", "t/c.jpg")], "cluster_id long, winner_id long, winner_path string, target_path string")
    ledger = spark.createDataFrame([(11, 5, "t/a.jpg"), (20, 6, "s/b.jpg"), (30, 7, "t/c.jpg")], "cluster_id long, organized_from_id long, target_path string")
    existing = spark.createDataFrame([("t/a.jpg",), ("s/b.jpg",)], "target_path string")
    assert {r["winner_id"]: r["action"] for r in organize.difference(planned, ledger, None, existing).collect()} == {5: "skip", 6: "replace", 7: "write"}


def test_throttles():
    n = os.cpu_count()
    shares = {("--throttle", "background"): 0.5, ("--throttle", "fullspeed"): 1.0, ("--cpu", "25"): 0.25, (): 0.9}
    assert all(cores(parser().parse_args(["quickhash", *a])) == max(1, int(n * share)) for a, share in shares.items())
    assert cores(parser().parse_args(["status"])) == n
    mb = {x: memory(parser().parse_args(["analyze", "--throttle", x])) for x in ("background", "balanced", "fullspeed")}
    assert mb["background"] < mb["balanced"] < mb["fullspeed"]
    assert memory(parser().parse_args(["status"])) is None
    assert [is_prerelease(x) for x in ("1.2.0", "v1.2", "1.2.0-rc1", "2.0b3")] == [False, False, True, True]


def test_exif_reader():
    from mendspan.sources.exif import exif_tags

    entries = b"".join(
        [
            b"\x0f\x01\x02\x00\x06\x00\x00\x00" + (38).to_bytes(4, "little"),
            b"\x69\x87\x04\x00\x01\x00\x00\x00" + (44).to_bytes(4, "little"),
        ]
    )
    block = b"II*\0\x08\0\0\0" + b"\x02\x00" + entries + b"\0\0\0\0" + b"Canon\0" + b"\x01\x00" + b"\x03\x90\x02\x00\x14\x00\x00\x00" + (62).to_bytes(4, "little") + b"\0\0\0\0" + b"2020:01:02 03:04:05\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block
    assert exif_tags(jpeg) == {"Make": "Canon", "DateTimeOriginal": "2020:01:02 03:04:05"}
    assert exif_tags(b"junk") == {}


def test_streaming_ingest(spark, tmp_path):
    from mendspan.streaming.ingest import ingest

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.range(5).select(F.col("id").alias("file_id"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"), F.lit(1).cast("long").alias("size"))
    rows.write.parquet(source)
    for _ in range(2):
        ingest(spark, source, "file_id long, content binary, size long", target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 5
    rows.withColumn("file_id", F.col("file_id") + 10).write.mode("append").parquet(source)
    ingest(spark, source, "file_id long, content binary, size long", target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 10
