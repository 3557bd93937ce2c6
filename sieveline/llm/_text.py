"""Vectorised word handling on UTF-8 bytes: words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased.

A word's 64-bit hash is a polynomial over its bytes, taken from prefix sums over a whole chunk, then
mixed; equal words have equal hashes everywhere and on every run."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.RandomState(20240607)
_TABLE = _rng.randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mult)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK)
        up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in bytes, chunk by chunk so that memory stays bounded."""
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw):  # end between words
            low = max(at, end - CHUNK)
            spaces = np.flatnonzero(_SPACE[raw[low:end]])
            if len(spaces):
                end = low + int(spaces[-1]) + 1
                break
            end = min(len(raw), end + CHUNK)
        part = raw[at:end]
        edge = np.diff(np.concatenate(([True], _SPACE[part], [True])).astype(np.int8))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(lo):
            up, down = _power(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
            h = (sums[hi] - sums[lo]) * down[lo]
            hashes.append(mix(h ^ ((hi - lo).astype(np.uint64) << np.uint64(48))))
            starts.append(lo + at)
            ends.append(hi + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copies; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


@dataclass
class Words:
    """Words of the rows lo..hi of a column: bytes of all rows, and of each word hash, start and end;
    row i has the words cuts[i - lo]..cuts[i - lo + 1]."""

    lo: int
    hi: int
    raw: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray


def word_chunks(col: pa.Array, size: int = CHUNK) -> Iterator[Words]:
    """The words of a column, rows joined by one space up to `size` bytes at a time."""
    data, off = column_bytes(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        lens = off[lo + 1 : hi + 1] - off[lo:hi]
        joined = np.full(int(lens.sum()) + hi - lo, 32, np.uint8)
        joined[np.arange(int(lens.sum())) + np.repeat(np.arange(hi - lo), lens)] = data[off[lo] : off[hi]]
        h, s, e = word_hashes(joined)
        yield Words(lo, hi, joined, h, s, e, np.concatenate(([0], np.searchsorted(s, np.cumsum(lens + 1)))))
        lo = hi


def doc_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows, row offsets into them)."""
    out, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for w in word_chunks(col):
        out.append(w.hashes)
        ends.append(w.cuts[1:] + ends[-1][-1])
    return np.concatenate(out), np.concatenate(ends)


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that per-batch arrays stay small."""
    for b in batches:
        for lo in range(0, b.num_rows, size):
            yield b.slice(lo, size)
    release()


def word_counts(col: pa.Array) -> np.ndarray:
    """Words of each row, without hashing them."""
    data, off = column_bytes(col)
    n = len(off) - 1
    out = np.zeros(n, np.int64)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + 4 * CHUNK, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        part = _SPACE[data[off[lo] : off[hi]]]
        starts = ~part
        starts[1:] &= part[:-1]
        cuts = off[lo : hi + 1] - off[lo]
        inner = cuts[:-1][cuts[:-1] < len(part)]
        starts[inner] |= ~part[inner]  # a row begins afresh whatever the row before ended with
        seen = np.concatenate(([0], np.cumsum(starts)))
        out[lo:hi] = seen[cuts[1:]] - seen[cuts[:-1]]
        lo = hi
    return out
