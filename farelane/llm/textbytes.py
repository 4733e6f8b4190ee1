"""Numpy kernels over UTF-8 text columns: words and their 64-bit hashes, many documents at a time.

All word separators are ASCII, so the kernels work on UTF-8 bytes and never build Python strings.
Work goes in blocks of about BLOCK bytes, so memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift, three rounds)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_HEAD = 128
_TABLE = mix(np.arange(1, _HEAD * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _words(raw: np.ndarray, first: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word of one block; `first` holds positions where documents begin."""
    word = ~SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[first] = word[first]
    start = np.flatnonzero(begins)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    at = np.flatnonzero(word)
    offset = np.searchsorted(at, start)
    size = np.diff(offset, append=len(at))
    return start, size, _hashes((LOWER[raw] if lower else raw)[at], at - np.repeat(start, size), offset)


def _hashes(byte: np.ndarray, place: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes that begins at offset; place is a byte's distance from its span's begin."""
    code = _TABLE[np.minimum(place, _HEAD - 1) * 256 + byte.astype(np.int64)]
    if (far := np.flatnonzero(place >= _HEAD)).size:
        code[far] = mix((place[far].astype(np.uint64) << np.uint64(9)) + byte[far].astype(np.uint64))
    return mix(np.add.reduceat(code, offset))


def span_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each of the ascending non-empty spans (start, size), by blocks; the size counts too."""
    out, i = np.empty(len(start), np.uint64), 0
    ends = np.cumsum(size)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")))
        offset = ends[i:j] - size[i:j] - (ends[i] - size[i])
        at = np.arange(int(size[i:j].sum())) + np.repeat(start[i:j] - offset, size[i:j])
        out[i:j] = _hashes(raw[at], at - np.repeat(start[i:j], size[i:j]), offset)
        i = j
    return mix(out + size.astype(np.uint64))


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (i, j, bounds, hashes): documents i..j-1 have the words hashes[bounds[k]:bounds[k+1]].

    A document longer than a block comes alone, its words gathered from blocks cut at separators.
    """
    for i, j, bounds, hashes, _, _ in word_spans(raw, off, lower):
        yield i, j, bounds, hashes


def word_spans(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As word_hashes(), with each word's start in raw and its length in bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= 2 * BLOCK:
            first = off[i:j] - lo
            start, size, hashes = _words(raw[lo:hi], first[first < hi - lo], lower)
            yield i, j, np.searchsorted(start, off[i : j + 1] - lo), hashes, start + lo, size
        else:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + BLOCK)
                while to < hi and not SPACE[raw[to - 1]]:
                    more = np.flatnonzero(SPACE[raw[to : min(hi, to + BLOCK)]])
                    to = to + int(more[0]) + 1 if len(more) else min(hi, to + BLOCK)
                start, size, hashes = _words(raw[at:to], np.zeros(1, np.int64), lower)
                parts.append((start + at, size, hashes))
                at = to
            start, size, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield i, j, np.array([0, len(hashes)]), hashes, start, size
        i = j


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order of their first word; empty where there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for d in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[d : d + n])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one document; the whole sequence as one when it has fewer words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(chain(hashes, min(k, len(hashes))) + np.uint64(min(k, len(hashes))))
