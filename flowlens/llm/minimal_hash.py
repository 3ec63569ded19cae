"""Minimal perfect hash over 128-bit keys, and the compact arrays it indexes.

The hash is a cascade of bit arrays: a key sits in the first level where no other key meets it, and
its number is the count of set bits before its own. Everything is array arithmetic, a few bits a key.
"""

from __future__ import annotations

import io

import numpy as np

from flowlens.llm.words import mixed
from flowlens.session import ship_by_value

_LOAD = 2  # bits of a level for each key that reaches it
_SEED = np.uint64(0xD6E8FEB86659FD93)


def _place(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(high ^ mixed(low + np.array([level], np.uint64) * _SEED)) % np.uint64(size)).astype(np.int64)


def build(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and packed bits for distinct keys ``(low, high)``."""
    sizes, packed = [], []
    while len(low):
        if len(sizes) > 200:
            raise ValueError("the keys of a minimal perfect hash must be distinct")
        size = -(-_LOAD * len(low) // 64) * 64
        at = _place(low, high, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        packed.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = ~alone[at]
        low, high = low[left], high[left]
    bits = np.concatenate(packed) if packed else np.zeros(0, "<u8")
    return np.array(sizes, dtype=np.int64), bits


class LineIndex:
    """Fingerprints, counts and first holders of lines, addressed by a minimal perfect hash."""

    def __init__(self, sizes, bits, fingerprints, counts, firsts):
        self.sizes, self.bits = sizes, bits
        self.fingerprints, self.counts, self.firsts = fingerprints, counts, firsts
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64)

    @classmethod
    def of(cls, low, high, counts, firsts) -> LineIndex:
        """Index distinct keys; ``high`` serves as the fingerprint."""
        out = cls(*build(low, high), *(np.zeros(len(low), t) for t in ("u8", "i8", "i8")))
        at = out.slots(low, high)
        out.fingerprints[at], out.counts[at], out.firsts[at] = high, counts, firsts
        return out

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Array position of each key, -1 for keys that no level holds."""
        found = np.full(len(low), -1, dtype=np.int64)
        open_, base = np.arange(len(low)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = base + _place(low[open_], high[open_], level, int(size))
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + int(size)
        return found

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is indexed, its count and its first holder (0 where it is not)."""
        at = self.slots(low, high)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == high[known]
        counts, firsts = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        counts[known], firsts[known] = self.counts[at[known]], self.firsts[at[known]]
        return known, counts, firsts

    def dump(self) -> bytes:
        out = io.BytesIO()
        for part in (self.sizes, self.bits, self.fingerprints, self.counts, self.firsts):
            np.save(out, part, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> LineIndex:
        source = io.BytesIO(raw)
        return cls(*(np.load(source, allow_pickle=False) for _ in range(5)))


ship_by_value(__name__)
