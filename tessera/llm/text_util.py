"""Vectorised words, hashes and shingles over Arrow string batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in blocks of about this many bytes; one longer text makes a block of its own.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LANES = 8


@dataclass
class Block:
    """Consecutive texts as one byte buffer; text k is buf[offs[k]:offs[k + 1]], a null text is empty."""

    batch: pa.RecordBatch
    buf: np.ndarray
    offs: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offs) - 1


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = col.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            yield Block(batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi


def release() -> None:
    """At a task's end: give freed memory back to the system, since Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place on a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one more at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~_SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for each span, eight bytes at a time; another one for each seed."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64)))
    if not len(size):
        return out
    wide = np.empty(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    wide[len(buf) :] = 0
    lanes = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))
    out = mix(out ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    for k in range(1, _LANES):
        at = np.flatnonzero(size > 8 * k)
        if not len(at):
            return out
        out[at] = mix(out[at] ^ (lanes[starts[at] + 8 * k] & _MASK[np.minimum(size[at] - 8 * k, 8)]))
    for i in np.flatnonzero(size > 8 * _LANES):
        out[i] = xxhash.xxh3_64_intdigest(wide[starts[i] : ends[i]].tobytes(), seed)
    return out


def windows(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows, and for each text the index of its first (one more at the end).

    A text of fewer words than width has its whole sequence as its one window; a text without words has none.
    """
    count = np.diff(first)
    n_win = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n_win)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    begin = np.repeat(first[:-1] - at[:-1], n_win) + np.arange(at[-1])
    length = np.repeat(np.minimum(count, width), n_win)
    padded = np.concatenate([word_hash, np.zeros(width, np.uint64)])
    out = mix(length.astype(np.uint64) * _M2)
    for k in range(width):
        nxt = padded[begin + k]
        if k:
            nxt = np.where(k < length, nxt, np.uint64(0))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + nxt)
    return out, at


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[buf]
