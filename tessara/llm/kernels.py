"""Vectorised text kernels over Arrow string buffers.

All functions work on the UTF-8 bytes of many rows at once.  A word is a run of
bytes other than space and 0x09-0x0D; those are ASCII, so a byte-level scan of
UTF-8 finds the same words as a scan of code points.  Rows never share words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once; a longer row is handled alone, whole.
SLICE = 1 << 19

_U = np.uint64
#: Spans up to this many bytes are hashed eight bytes at a time, all at once; longer ones one by one.
LONG_SPAN = 64
_SIZE, _STEP = (_U(0x2545F4914F6CDD1D), _U(0x9E3779B97F4A7C15)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def give_back() -> None:
    """Return freed memory to the system: workers are kept for later tasks, and their allocators keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: an invertible scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Rows:
    """A slice of rows: bytes, row offsets into them, and the index of the first row."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a slice: byte starts and ends; row i holds words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Rows]:
    """Cut a string column into slices of at most `limit` bytes, or one longer row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def find_words(rows: Rows) -> Words:
    data, offsets = rows.data, rows.offsets
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a row starts here
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64-bit hashes of each byte span, one independent row for each of 1 or 2 lanes; equal bytes, equal hashes.

    Up to LONG_SPAN bytes, each step scrambles the state with the next eight
    bytes, so spans of one size up to eight bytes never collide; longer spans
    take a cryptographic digest.
    """
    size = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = [size.astype(np.uint64) * _SIZE[k] for k in range(lanes)]
    alive = np.flatnonzero(size <= LONG_SPAN)
    for at in range(0, LONG_SPAN, 8):
        alive = alive[size[alive] > at]
        if not len(alive):
            break
        value = eights[starts[alive] + at] & _MASKS[np.minimum(size[alive] - at, 8)]
        for k in range(lanes):
            out[k][alive] = mix(out[k][alive] ^ value * _STEP[k])
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        for k in range(lanes):
            out[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out[0] if lanes == 1 else np.stack(out)


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each of disjoint, ascending byte spans: two have one number if and only if their bytes are equal."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    values = data[np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)]
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for codes[i:i+n] of every i: two have one number if and only if they are equal; codes are under 2**31."""
    out, have = codes, 1
    while have < n and len(out):
        step = min(have, n - have)
        out = pd.factorize(out[: max(0, len(out) - step)] << 32 | out[step:])[0].astype(np.int64)
        have += step
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for every i (those that cross rows included; mask with `gram_valid`)."""
    out, have = words, 1
    while have < n and len(out):
        step = min(have, n - have)
        out = mix(out[: max(0, len(out) - step)] * _U(0xD6E8FEB86659FD93 + 2 * step) + out[step:])
        have += step
    return out


def gram_valid(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each position lie in one row, aligned with `gram_hashes`."""
    m = max(0, len(words.starts) - n + 1)
    last = np.repeat(words.first[1:], words.counts)[:m]
    return np.arange(m) + n <= last


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for every i."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions of 0..n-1 that lie in [m, m + width) of some marked m."""
    edge = np.zeros(n + width + 1, dtype=np.int32)
    at = np.flatnonzero(marks)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[:n] > 0
