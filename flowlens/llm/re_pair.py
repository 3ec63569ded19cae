"""Grammars of word sequences by Re-Pair, all texts of a batch sharing their nonterminals.

Every round counts the pairs of neighbouring symbols that may have changed and replaces pairs found
twice or more, where two overlap the more frequent one; equal neighbours pair off from the left. A pair's
symbol is a hash of its two, so it is the same in every text and round. Once no pair repeats, what is left
of each text is paired off level by level. No pair crosses the end of a text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from flowlens.llm.words import mixed
from flowlens.session import ship_by_value

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Nodes(NamedTuple):
    """Occurrences of nonterminals: symbol, first word, words of the left child, words."""

    symbol: np.ndarray
    start: np.ndarray
    left: np.ndarray
    size: np.ndarray


class _Sequence:
    """Symbols not yet paired, in text order, with the nonterminals made so far."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, least: int):
        self.symbol, self.least = mixed(words + _ODD), least
        self.start = np.arange(len(words))
        self.size = np.ones(len(words), dtype=np.int64)
        self.last = np.zeros(len(words), dtype=bool)  # symbol that ends its text
        ends = bounds[1:][np.diff(bounds) > 0]
        self.last[ends - 1] = True
        self.made: list[Nodes] = []

    def pairs(self, at: np.ndarray) -> np.ndarray:
        return mixed(mixed(self.symbol[at]) * _ODD + self.symbol[at + 1])

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace the pairs that start at ``at``; marks of symbols kept, and of new ones among them."""
        left = self.size[at]
        self.size[at] += self.size[at + 1]
        self.symbol[at] = symbols
        self.last[at] = self.last[at + 1]
        large = self.size[at] >= self.least
        some = at[large]
        self.made.append(Nodes(symbols[large], self.start[some], left[large], self.size[some]))
        kept = np.ones(len(self.symbol), dtype=bool)
        kept[at + 1] = False
        new = np.zeros(len(self.symbol), dtype=bool)
        new[at] = True
        self.symbol, self.start, self.size, self.last = (
            x[kept] for x in (self.symbol, self.start, self.size, self.last)
        )
        return kept, new[kept]


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Pairs of no lower rank than their neighbours, every other one among neighbours of equal rank.

    ``at`` holds the places of the pairs, ascending; neighbours stand at the next place.
    """
    near = np.diff(at) == 1
    before = np.concatenate([[0], np.where(near, rank[:-1], 0)])
    after = np.concatenate([np.where(near, rank[1:], 0), [0]])
    place = np.arange(len(rank))
    first = np.maximum.accumulate(np.where(rank != before, place, 0))
    return np.flatnonzero((rank >= before) & (rank >= after) & ((place - first) % 2 == 0))


def grammar(words: np.ndarray, bounds: np.ndarray, least: int) -> Nodes:
    """Nonterminals of at least ``least`` words in the texts ``words[bounds[i]:bounds[i + 1]]``."""
    texts = _Sequence(words, bounds, least)
    live = np.ones(len(words), dtype=bool)  # pairs that may repeat
    while True:
        at = np.flatnonzero(live & ~texts.last)
        symbols = texts.pairs(at)
        kinds, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        often = counts[inverse] > 1
        if not often.any():
            break
        at, symbols, inverse = at[often], symbols[often], inverse[often]
        taken = _chosen(at, counts[inverse] * len(kinds) + inverse)
        live[:] = False
        live[at] = True
        kept, new = texts.replace(at[taken], symbols[taken])
        live = live[kept] | new
        live[:-1] |= new[1:]
    while len(at := np.flatnonzero(~texts.last)):
        first = np.concatenate([[True], texts.last[:-1]])
        place = np.arange(len(first))
        place -= np.maximum.accumulate(np.where(first, place, 0))
        at = at[place[at] % 2 == 0]
        texts.replace(at, texts.pairs(at))
    return Nodes(*[np.concatenate(x) for x in zip(*texts.made, strict=True)]) if texts.made else Nodes(
        np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    )


ship_by_value(__name__)
