"""Words of whole text columns as NumPy arrays.

All functions take the UTF-8 bytes of many texts laid end to end, with their bounds, as an Arrow
string column holds them. Words are runs of bytes that a 256-entry table marks; every table marks
or leaves all bytes of a non-ASCII character alike, so byte runs are character runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from flowlens.session import ship_by_value

_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: A-Z to a-z, every other byte unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words that any white space ends
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(_SPACE)] = False

#: bytes of words of digits, lower-case letters and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


class Words(NamedTuple):
    """Words of several texts: byte bounds in the joined bytes, and each text's word range."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one longer text."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def split(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]`` made of the bytes in ``table``."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.take(table, data, out=inside[:-1])
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]  # a text's edge ends a word as well
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


def hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, left = words.starts, words.ends - words.starts
    out = mixed((eight[at] & _MASK[np.minimum(left, 8)]) + left.astype(np.uint64) * _M2)
    index = np.arange(len(at))
    while len(keep := np.flatnonzero(left > 8)):
        index, at, left = index[keep], at[keep] + 8, left[keep] - 8
        out[index] = mixed(out[index] * _M1 + (eight[at] & _MASK[np.minimum(left, 8)]))
    return out


def sequence_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive values."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = mixed(out) + h[k : n + k]
    return mixed(out)


ship_by_value(__name__)
