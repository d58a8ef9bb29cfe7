"""Vectorised word and shingle hashes of UTF-8 texts (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260812))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _M(2) + _M(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = _M(0x9E3779B97F4A7C15)
_STEP = _M(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of text that are hashed at a time; a longer text is taken alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _M(30))
    x = x * _M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M(27))
    x = x * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


_powers = np.cumprod(np.full(64, _PRIME, np.uint64))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(2 * n, _PRIME, np.uint64))
    return _powers


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (rows + 1) of runs of texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of each word and the number of words before each text (texts + 1)."""
    if not len(data):
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < len(data)]] = False
    last = at[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    count = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, count
    size = ends - starts
    own = data[inside]
    if lower:
        own = _LOWER[own]
    first = np.cumsum(size) - size
    place = np.arange(len(own)) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[own] * _power(int(size.max()))[place], first)
    return mix(h + size.astype(np.uint64)), starts, ends, count


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its width-word shingles (A-Z lower-cased); of 1 to width - 1 words, one."""
    step = np.cumprod(np.full(width, _STEP, np.uint64))
    for _, data, at in text_chunks(texts):
        h, _, _, count = word_hashes(data, at, True)
        if len(h) >= width:
            sums = sum(h[k : len(h) - width + 1 + k] * step[k] for k in range(width))
            rolled = mix(sums)
        for a, b in zip(count[:-1].tolist(), count[1:].tolist(), strict=True):
            if b - a >= width:
                x = np.sort(rolled[a : b - width + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            elif b > a:
                yield mix(np.array([(h[a:b] * step[: b - a]).sum() + _M(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
