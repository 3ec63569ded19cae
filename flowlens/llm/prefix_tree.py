"""Prefix tree of ordered sets, walked with another set to find those that overlap it enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from flowlens.session import ship_by_value


class _Node:
    """A run of elements that all sets below share, after the node's parents' runs."""

    __slots__ = ("run", "end", "leaves", "children", "least", "most")

    def __init__(self, run: np.ndarray, end: int):
        self.run, self.end = run, end
        self.leaves: list[int] = []
        self.children: list[_Node] = []


class PrefixTree:
    """Sets given as ascending arrays; elements ascend in the order that all sets follow."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.common = [0] * len(sets)  # elements shared with the set before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.common[i] = int(differ[0]) if len(differ) else k
        self.root = self._node(0, len(sets), 0) if sets else None

    def _node(self, low: int, high: int, depth: int) -> _Node:
        end = min(self.common[low + 1 : high], default=len(self.sets[low]))
        node = _Node(self.sets[low][depth:end], end)
        sizes = [len(s) for s in self.sets[low:high]]
        node.least, node.most = min(sizes), max(sizes)
        while low < high and len(self.sets[low]) == end:
            node.leaves.append(self.order[low])
            low += 1
        while low < high:
            stop = low + 1
            while stop < high and self.common[stop] > end:
                stop += 1
            node.children.append(self._node(low, stop, end))
            low = stop
        return node

    def matches(self, other: np.ndarray) -> Iterator[int]:
        """Numbers of the sets with ``100 * intersection >= percent * union``."""
        p, q = self.percent, len(other)
        if self.root is None or not q:
            return
        open_ = [(self.root, 0, q)]
        while open_:
            node, overlap, left = open_.pop()
            # what the subtree and the rest of the other set can still share
            possible = overlap + min(node.most - node.end + len(node.run), left)
            if (
                (100 + p) * possible < p * (node.least + q)
                or 100 * node.most < p * q
                or p * node.least > 100 * q
            ):
                continue
            if len(node.run):
                at = np.searchsorted(other, node.run)
                inside = at < q
                overlap += int((other[at[inside]] == node.run[inside]).sum())
                left = q - int(np.searchsorted(other, node.run[-1], side="right"))
            if (100 + p) * overlap >= p * (node.end + q):
                yield from node.leaves
            open_ += [(child, overlap, left) for child in node.children]


ship_by_value(__name__)
