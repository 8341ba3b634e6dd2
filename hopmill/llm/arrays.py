"""Texts of an Arrow batch as flat numpy arrays: bytes, words, shingles; and links inside a block of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of prefix hashes and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A byte's value in prefix hashes.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offsets of its texts; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets): whole texts, at most so many bytes together."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """prefix[i]: hash of the first i bytes; with powers(), the hash of any stretch is a difference and a product."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data))[0], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    prefix, back = prefix_hashes(_LOWER[data]), powers(len(data) + 1)[1]
    h = mixed((prefix[e] - prefix[s]) * back[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(offsets, s, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; of fewer words, of the whole sequence."""
    h, text = word_hashes(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    g = mixed(h + np.uint64(k))
    for j in range(1, k):
        g = g[:-1] if len(g) else g
        g = mixed(g * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(g)]) if len(h) > j else g[:0]
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        n = b - a
        if n >= k:
            v = np.sort(g[a : b - k + 1])
            out.append(v[np.concatenate(([True], v[1:] != v[:-1]))])
        elif n:
            w = mixed(h[a : a + 1] + np.uint64(1 << 32) + np.uint64(n))
            for j in range(a + 1, b):
                w = mixed(w * np.uint64(0xD6E8FEB86659FD93) + h[j : j + 1])
            out.append(w)
        else:
            out.append(h[:0])
    return out
