"""Vectorised word splitting and hashing over UTF-8 buffers.

Words and windows are handled as byte ranges of the Arrow buffer and 64-bit
fingerprints; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text per vectorised step; bounds a worker's memory for any number of rows.
STEP_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: [^\x20\x09-\x0D]
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(base: np.uint64):
    kept = np.ones(1, np.uint64)

    def up_to(n: int) -> np.ndarray:
        nonlocal kept
        if len(kept) < n:
            grown = np.full(max(n, 2 * len(kept)), base, np.uint64)
            grown[0] = 1
            kept = np.cumprod(grown, dtype=np.uint64)
        return kept[:n]

    return up_to


powers, inverse_powers = _powers(_BASE), _powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of symbols[i:j], times base**i."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    return mixed((prefix[end] - prefix[start]) * inverse_powers(int(start[-1]) + 1 if len(start) and start[-1] >= start.max() else int(start.max()) + 1)[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(batches, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a slice: byte ranges, document index, and 64-bit hashes on demand."""

    def __init__(self, column: pa.Array, keep: np.ndarray = BLANK_SPLIT, fold: bool = True):
        raw, self.off = text_buffers(column)
        self.raw = FOLD[raw] if fold else raw
        n = len(raw)
        m = keep[self.raw]
        before = np.zeros(n, bool)
        before[1:] = m[:-1]
        before[self.off[self.off < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = m[1:]
        after[self.off[self.off > 0] - 1] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        #: first word of each document, and one past the last
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(_BYTE[self.raw]), self.start, self.end)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes at which ``size`` consecutive words of one document start."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    total = int(count.sum())
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + base


def window_hashes(word_hash: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return range_hash(prefix_hash(word_hash), starts, starts + size)
