"""Words and byte windows of whole Arrow text columns as flat NumPy arrays: no Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D. In UTF-8 these bytes never occur inside a character, so byte
positions are enough. A word's hash covers all its bytes, eight at a time, each step through a 64-bit finaliser.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
U = np.uint64
CHUNK_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, never splitting a row: memory follows the longest text."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Words:
    """Word starts, ends and row numbers of a text column; ``first[r]:first[r + 1]`` are the words of row ``r``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~SPACE[data]
        begins, ends = np.empty(n, bool), np.empty(n, bool)
        if n:
            begins[0], begins[1:] = word[0], word[1:] & ~word[:-1]
            ends[-1], ends[:-1] = word[-1], word[:-1] & ~word[1:]
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]         # first bytes of the rows that have any
            begins[edge] = word[edge]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[last] = word[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))   # the eight bytes from each position on
    length = ends - starts
    out = mix(length.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(1))
    live, at = np.arange(len(starts)), starts
    left = length
    while len(live):
        block = eight[at]
        short = left < 8
        block[short] &= (U(1) << (left[short].astype(np.uint64) * U(8))) - U(1)
        out[live] = mix(out[live] ^ block)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ordered combination of two hash columns."""
    return mix(left * U(0x9E3779B97F4A7C15) + mix(right ^ U(0xD6E8FEB86659FD93)))


def sequence_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries, from runs of doubling width; shorter input gives none."""
    if len(word) < width:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, word, 1
    bits = width
    while bits:
        if bits & 1:
            n = len(word) - have - size + 1
            out = power[:n].copy() if out is None else combine(out[:n], power[have:have + n])
            have += size
        bits >>= 1
        if bits:
            power = combine(power[:-size], power[size:])
            size *= 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
