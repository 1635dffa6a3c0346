"""Sets of hashed word shingles, made batch by batch on the bytes of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z only
_BASE = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, inverse
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_tables: list[np.ndarray] = []


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word of texts that lie one after another in data."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not _tables or len(_tables[0]) < len(data) + 1:
        _tables[:] = _powers(max(len(data) + 1, 1 << 16))
    up, down = _tables
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than width has one, of no words none."""
    words, text = word_hashes(data, offsets)
    number = len(offsets) - 1
    counts = np.bincount(text, minlength=number)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(0, np.uint64)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * _STEP + words[k : k + len(rolled)]
        rolled = mixed(rolled)
    out = []
    for n in range(number):
        a, b = firsts[n], firsts[n + 1]
        if b - a >= width:
            part = np.sort(rolled[a : b - width + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for word in words[a:b]:
                short = short * _STEP + word
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes."""
    total = np.array([hashes.sum(dtype=np.uint64)], np.uint64) * _STEP + np.uint64(len(hashes))
    return int(mixed(total + np.bitwise_xor.reduce(mixed(hashes))).view(np.int64)[0])


def portions(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `most` bytes of text each: (slice, bytes, offsets). Null counts as empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        stop = min(stop, len(texts))
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop
