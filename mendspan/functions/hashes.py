"""Hashes: quick and full fingerprints, perceptual image hashes, bit packing and distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes read from either end of a file that is larger than both.
EDGE = 65536


def quick_bytes(content: Column, size: Column) -> Column:
    """What a quick fingerprint covers: head and tail (or all of a small file) and the size, little-endian."""
    head_tail = F.when(size <= 2 * EDGE, content).otherwise(F.concat(F.substring(content, 1, EDGE), F.substring(content, -EDGE, EDGE)))
    little = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(size), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))
    return F.concat(head_tail, little)


def quick_digest(content: Column, size: Column) -> Column:
    """MD5 over ``quick_bytes``; null content gives null. Equal just when quick hashes are."""
    return F.md5(quick_bytes(content, size))


@F.pandas_udf(T.StringType())
def xxh64(data: pd.Series) -> pd.Series:
    """XXH64, seed 0, as 16 hex digits: the built-in one has another seed."""
    import xxhash

    return data.map(lambda x: None if x is None else xxhash.xxh64_hexdigest(bytes(x)))


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bucket(phash: Column) -> Column:
    """The top 16 bits."""
    return F.shiftrightunsigned(phash, 48)


def pack_bits(bits: Column) -> Column:
    """64 booleans, the first one highest, as a long."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("int").cast("long")))


def bits_of(value: Column) -> Column:
    """The 64 bits of a long, the highest first."""
    return F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.getbit(value, i).cast("int"))


def resized(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-averaged: each output pixel is the mean of the stretch of input pixels it covers."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        edges = np.arange(n_out + 1) * n_in / n_out
        lo, hi = edges[:-1, None], edges[1:, None]
        cells = np.arange(n_in)[None, :]
        covered = np.clip(np.minimum(hi, cells + 1) - np.maximum(lo, cells), 0, None)
        return covered / covered.sum(axis=1, keepdims=True)

    return weights(grey.shape[0], height) @ grey.astype(np.float64) @ weights(grey.shape[1], width).T


def to_long(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel().astype(np.uint8)).view(">i8")[0])


def perceptual_hash(grey: np.ndarray) -> int:
    """The 8 x 8 lowest frequencies of a 32 x 32 image, each against their median."""
    n = 32
    k = np.arange(n)
    cosines = np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))
    low = (cosines @ resized(grey, n, n) @ cosines.T)[:8, :8]
    return to_long(low > np.median(low))


def difference_hash(grey: np.ndarray) -> int:
    """Whether each pixel of a 9 x 8 image is brighter than the one to its left."""
    small = resized(grey, 8, 9)
    return to_long(small[:, 1:] > small[:, :-1])


def valid_rows(grey: np.ndarray | None, least: float = 8.0) -> int | None:
    """The last row whose variance exceeds ``least``, counted from 1; 0 if none does, null without pixels."""
    if grey is None or grey.ndim != 2 or grey.size == 0:
        return None
    alive = np.flatnonzero(grey.astype(np.float64).var(axis=1) > least)
    return int(alive[-1]) + 1 if len(alive) else 0


def majority(hashes: list[int]) -> int | None:
    """Each bit as more than half of the hashes have it."""
    if not hashes:
        return None
    bits = np.unpackbits(np.array(hashes, dtype=">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return to_long(bits.sum(axis=0) > len(hashes) / 2)
