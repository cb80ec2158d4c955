"""Readers of file content by path, on the executors: fingerprints with seeks, and one pass of analysis per image."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from mendspan.functions.hashes import EDGE, difference_hash, majority, perceptual_hash, valid_rows
from mendspan.functions.names import RAW


def quick_hash(path: str, size: int) -> str:
    """XXH64 over head and tail (or all of a small file) and the little-endian size; reads 128 KiB at most."""
    import xxhash

    with open(path, "rb") as f:
        data = f.read(2 * EDGE) if size <= 2 * EDGE else f.read(EDGE)
        if size > 2 * EDGE:
            f.seek(-EDGE, os.SEEK_END)
            data += f.read(EDGE)
    return xxhash.xxh64_hexdigest(data + size.to_bytes(8, "little"))


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _hashed(batches: Iterator[pd.DataFrame], stage: str) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out, errors = [], []
        for path, size in zip(rows["path"], rows["size"], strict=True):
            try:
                out.append(quick_hash(path, int(size)) if stage == "quickhash" else sha256(path))
                errors.append(None)
            except OSError as e:
                out.append(None)
                errors.append(f"{stage}: {e}"[:200])
        yield pd.DataFrame({"file_id": rows["file_id"], "hash": out, "error": errors})


def hash_stage(files: DataFrame, stage: str) -> DataFrame:
    """(file_id, hash, error) of files (file_id, path, size); ``stage`` is ``quickhash`` or ``fullhash``. A failed file keeps a null hash and is tried again."""
    return files.select("file_id", "path", "size").mapInPandas(lambda b: _hashed(b, stage), "file_id long, hash string, error string")


def grey_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Luma of an image-source row (BGR, BGRA or one channel); null if it wasn't decoded."""
    if height <= 0 or width <= 0:
        return None
    pixels = np.frombuffer(data, dtype=np.uint8)[: height * width * channels].reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def _analyzed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for r in rows.itertuples():
            grey = grey_of(r.height, r.width, r.nChannels, r.data)
            if grey is None:
                out.append((r.origin, False, None, None, None, None, None))
            else:
                grey8 = np.round(grey)
                out.append((r.origin, True, r.width, r.height, valid_rows(grey8), perceptual_hash(grey8), difference_hash(grey8)))
        yield pd.DataFrame(out, columns=["origin", "decode_ok", "width", "height", "valid_rows", "phash", "dhash"])


def analyze_images(images: DataFrame) -> DataFrame:
    """Decoding result, live rows and both hashes of rows of the ``image`` source, each pixel matrix being read once."""
    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(_analyzed, "origin string, decode_ok boolean, width int, height int, valid_rows int, phash long, dhash long")


def tail_of(path: str, n: int = 2) -> bytes | None:
    try:
        with open(path, "rb") as f:
            f.seek(-min(n, os.fstat(f.fileno()).st_size), os.SEEK_END)
            return f.read()
    except OSError:
        return None


def read_tags(path: str, timeout: float = 15.0) -> str | None:
    """Tag JSON of the tag tool, or of the own reader where there is none; null on failure."""
    tool = shutil.which("exiftool")
    if tool:
        try:
            done = subprocess.run([tool, "-j", "-DateTimeOriginal", "-CreateDate", "-MediaCreateDate", "-Make", "-Model", "-SerialNumber", "-InternalSerialNumber", "-LensModel", path], capture_output=True, timeout=timeout, check=False)
            if done.returncode == 0:
                return done.stdout.decode("utf-8", "replace")
        except (OSError, subprocess.TimeoutExpired):
            pass
    from mendspan.sources.exif import exif_tags

    try:
        with open(path, "rb") as f:
            tags = exif_tags(f.read(1 << 20))
    except OSError:
        return None
    return json.dumps([tags]) if tags else None


def video_hash(path: str) -> tuple[int | None, int | None]:
    """Majority hashes of frames 0, 30, 60, 90 and 120; nulls without the frame tool."""
    tool = shutil.which("ffmpeg")
    if not tool:
        return None, None
    try:
        done = subprocess.run([tool, "-v", "error", "-i", path, "-vf", r"select=not(mod(n\,30)),scale=256:256,format=gray", "-vsync", "0", "-frames:v", "5", "-f", "rawvideo", "-"], capture_output=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None, None
    frames = np.frombuffer(done.stdout, dtype=np.uint8)
    frames = frames[: len(frames) // 65536 * 65536].reshape(-1, 256, 256)
    return majority([perceptual_hash(x) for x in frames]), majority([difference_hash(x) for x in frames])


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        video = [video_hash(p) if k == "video" else (None, None) for p, k in zip(rows["path"], rows["kind"], strict=True)]
        yield pd.DataFrame({"file_id": rows["file_id"], "tail": [tail_of(p) for p in rows["path"]], "tag_json": [read_tags(p) for p in rows["path"]], "video_phash": pd.array([v[0] for v in video], dtype="Int64"), "video_dhash": pd.array([v[1] for v in video], dtype="Int64")})


def describe_files(files: DataFrame) -> DataFrame:
    """(file_id, tail, tag_json, video_phash, video_dhash) of files (file_id, path, kind)."""
    return files.select("file_id", "path", "kind").mapInPandas(_described, "file_id long, tail binary, tag_json string, video_phash long, video_dhash long")


__all__ = ["RAW", "analyze_images", "describe_files", "hash_stage", "quick_hash", "read_tags", "sha256", "video_hash"]
