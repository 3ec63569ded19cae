"""FM-index over word sequences: suffix array, wavelet matrix, backward search and locating.

Symbols are 64-bit word hashes. Every text ends in a terminator of its own, so matches never run
from one text into the next. All steps work on arrays of many suffixes or many phrases at once.
"""

from __future__ import annotations

import numpy as np

from flowlens.session import ship_by_value

_ONE = np.uint64(1)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence in which every suffix has a terminator found nowhere else.

    Prefix doubling that sorts only the suffixes whose order is still open.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    fresh = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])[:n]
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = slot  # first place of the group of suffixes that are still alike
    alone = fresh & np.concatenate([fresh[1:], [True]])[:n]
    open_, width = order[~alone], 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + width]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = key // n
        at = np.arange(len(key))
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        place = group + at - np.maximum.accumulate(np.where(starts, at, 0))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        order[place] = open_
        rank[open_] = place[np.maximum.accumulate(np.where(fresh, at, 0))]
        alone = fresh & np.concatenate([fresh[1:], [True]])
        open_ = open_[~alone]
        width *= 2
    return order


class BitVector:
    """Bits with constant-time counts of the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, dtype=np.uint8)])
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE == _ONE

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)


class WaveletMatrix:
    """Symbols of a sequence by bit planes, for access and rank."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.planes: list[tuple[int, int, BitVector]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (seq >> bit) & 1 == 1
            self.planes.append((bit, int(len(seq) - ones.sum()), BitVector(ones)))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def follow(self, symbols: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each place ends up when only its symbol is followed down the planes."""
        for bit, zeros, plane in self.planes:
            one = (symbols >> bit) & 1 == 1
            ranks = [plane.rank(p) for p in places]
            places = tuple(
                np.where(one, zeros + r, p - r) for p, r in zip(places, ranks, strict=True)
            )
        return places

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where the place ends up."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for bit, zeros, plane in self.planes:
            one, rank = plane.get(at), plane.rank(at)
            symbols |= one.astype(np.int64) << bit
            at = np.where(one, zeros + rank, at - rank)
        return symbols, at


class FMIndex:
    """Index of one shard's texts, given as word hashes and each text's bounds."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, sample: int = 8):
        texts, sizes = len(bounds) - 1, np.diff(bounds)
        self.vocabulary, ranks = np.unique(hashes, return_inverse=True)
        #: first place of each text in the sequence; its terminator comes before the next text
        self.firsts = bounds[:-1] + np.arange(texts)
        seq = np.empty(len(hashes) + texts, dtype=np.int64)
        ends = self.firsts + sizes
        words = np.ones(len(seq), dtype=bool)
        words[ends] = False
        seq[ends] = np.arange(texts)
        seq[words] = ranks + texts
        order = suffix_array(seq)
        last = np.maximum(seq[order - 1] - texts + 1, 0)  # 0: any terminator
        bits = max(1, int(len(self.vocabulary)).bit_length())
        self.tree = WaveletMatrix(last, bits)
        #: suffixes that start with a smaller symbol, by symbol
        self.smaller = np.concatenate([[0], texts + np.searchsorted(np.sort(ranks), np.arange(len(self.vocabulary)))])
        marked = order % sample == 0
        starts = np.zeros(len(seq), dtype=bool)
        starts[self.firsts] = True
        marked |= starts[order]
        self.marks, self.places = BitVector(marked), order[marked]
        self.size = len(seq)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase; ``phrases`` is a matrix of word hashes, filled from the left."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        ids = np.searchsorted(self.vocabulary, phrases)
        known = ids < len(self.vocabulary)
        known[known] = self.vocabulary[ids[known]] == phrases[known]
        inside = np.arange(phrases.shape[1])[None, :] < sizes[:, None]
        alive = np.flatnonzero((known | ~inside).all(axis=1) & (sizes > 0))
        high[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for back in range(1, phrases.shape[1] + 1):
            alive = alive[sizes[alive] >= back]
            if not len(alive):
                break
            symbols = ids[alive, sizes[alive] - back] + 1
            kinds, inverse = np.unique(symbols, return_inverse=True)
            (base,) = self.tree.follow(kinds, np.zeros(len(kinds), dtype=np.int64))
            a, b = self.tree.follow(symbols, low[alive], high[alive])
            shift = self.smaller[symbols] - base[inverse]
            low[alive], high[alive] = a + shift, b + shift
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and word number of the suffixes at the given places of the suffix order."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            done = self.marks.get(rows)
            out[open_[done]] = self.places[self.marks.rank(rows[done])] + steps
            open_, rows, steps = open_[~done], rows[~done], steps + 1
            if len(open_):
                symbols, at = self.tree.access(rows)
                (base,) = self.tree.follow(symbols, np.zeros(len(rows), dtype=np.int64))
                rows = self.smaller[symbols] + at - base
        texts = np.searchsorted(self.firsts, out, side="right") - 1
        return texts, out - self.firsts[texts]


ship_by_value(__name__)
