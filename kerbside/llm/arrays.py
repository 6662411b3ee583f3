"""Array helpers for whole texts inside tasks: words, hashes, sorted key lists as bytes."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes and of the final mixing; any odd 64-bit numbers would do.
WORD_BASE, GRAM_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def released() -> None:
    """Give freed memory back to the system: a reused worker would hold what an earlier stage has needed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX_1
    h ^= h >> np.uint64(27)
    h *= _MIX_2
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    """WORD_BASE to the power 0 … n-1, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 256), WORD_BASE, np.uint64)
        _POWERS[0] = 1
        _POWERS = np.multiply.accumulate(_POWERS)
    return _POWERS[:n]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins (one more at the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def portions(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive documents of together about ``most`` bytes, or a single longer one."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, side="right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, split at ASCII white space), and where each text's words begin."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(starts[1:] > starts[:-1])
    at, to = starts[full], starts[full + 1] - 1
    begins[at], ends[to] = inside[at], inside[to]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(begins, starts)
    if not len(begins):
        return np.empty(0, np.uint64), first
    length = ends - begins
    offset = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=offset[1:])
    letters = _LOWER[data[inside]].astype(np.uint64)
    letters += np.uint64(1)
    letters *= powers(int(length.max()))[np.arange(len(letters)) - np.repeat(offset, length)]
    return mix(np.add.reduceat(letters, offset) + length.astype(np.uint64)), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive words from every word on (fewer results than words by n - 1)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= GRAM_BASE
        out += h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting takes a small part of the time of ``np.unique``, which hashes them."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


def bucket_starts(n: int) -> np.ndarray:
    """Lower ends of ``n`` equal ranges of the 64-bit key space."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def pack(keys: np.ndarray, shift: int = 0, values: np.ndarray | None = None) -> bytes:
    """Ascending keys (without their last ``shift`` bits) as gaps in as few bytes as the largest needs, then values."""
    short = keys >> np.uint64(shift)
    gaps = np.diff(short)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    # gaps seldom reach into their highest byte
    top = zlib.compress(planes[-1].tobytes(), 1) if len(gaps) else b""
    head = np.array([len(keys), width, shift, len(top), int(short[0]) if len(keys) else 0], np.uint64).tobytes()
    tail = b""
    if values is not None:
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(t).max)
        tail = np.dtype(kind).str.encode() + zlib.compress(values.astype(kind).tobytes(), 1)
    return head + top + planes[:-1].tobytes() + tail


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys (their last ``shift`` bits zero) and values of ``pack``."""
    n, width, shift, top, first = (int(x) for x in np.frombuffer(packed, np.uint64, 5))
    at = 40
    gaps = np.zeros((max(n - 1, 0), 8), np.uint8)
    if len(gaps):
        gaps[:, width - 1] = np.frombuffer(zlib.decompress(packed[at : at + top]), np.uint8)
        at += top
        planes = np.frombuffer(packed, np.uint8, (n - 1) * (width - 1), at).reshape(width - 1, n - 1)
        gaps[:, : width - 1] = planes.T
        at += planes.size
    keys = np.zeros(n, np.uint64)
    if n:
        keys[0] = first
        keys[1:] = gaps.view(np.uint64).ravel()
        keys = np.cumsum(keys, dtype=np.uint64) << np.uint64(shift)
    if at == len(packed):
        return keys, None
    kind = np.dtype(packed[at : at + 3].decode())
    return keys, np.frombuffer(zlib.decompress(packed[at + 3 :]), kind)


def flags(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unflags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: where each begins and ends, and where each text's runs begin."""
    inside = LETTER[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(starts[1:] > starts[:-1])
    at, to = starts[full], starts[full + 1] - 1
    begins[at], ends[to] = inside[at], inside[to]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begins, ends, np.searchsorted(begins, starts)


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes, A-Z lower-cased."""
    if not len(begins):
        return np.empty(0, np.uint64)
    length = ends - begins
    offset = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=offset[1:])
    place = np.arange(int(length.sum())) - np.repeat(offset, length)
    letters = _LOWER[data[place + np.repeat(begins, length)]].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(length.max()))[place]
    return mix(np.add.reduceat(letters, offset) + length.astype(np.uint64))
