"""Vectorised word splitting and hashing of Arrow string columns, without a Python object per word.

A word is a maximal run of bytes outside U+0020 and U+0009..U+000D; a null text has no words. Hashes are 64-bit:
a polynomial over the word's UTF-8 bytes, mixed, so that they are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 document offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the document each belongs to. No word crosses documents."""
    inside = member[raw]
    cuts = offsets[:-1]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(inside):
        before[0] = False
        before[cuts[cuts < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(inside):
        after[-1] = False
        after[cuts[(cuts > 0) & (cuts <= len(inside))] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of n consecutive word hashes at each position that has n words from there on."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    done, size = words.copy(), 1
    out, out_size = None, 0
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, out_size = done, size
            else:  # what was gathered first, then this piece
                m = len(words) - out_size - size + 1
                out = out[:m] * _power(size) + done[out_size : out_size + m]
                out_size += size
        rest >>= 1
        if rest:
            m = len(done) - size
            done = done[:m] * _power(size) + done[size:]
            size *= 2
    return mix(out[: len(words) - n + 1])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(STEP), n, 1 << 64))


def batches(batch_iter, most_bytes: int = 4 << 20):
    """Record batches cut so that none holds more than about ``most_bytes`` of data (one row may exceed it)."""
    for batch in batch_iter:
        if batch.num_rows < 2 or batch.nbytes <= most_bytes:
            yield batch
            continue
        step = max(1, int(batch.num_rows * most_bytes / batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
