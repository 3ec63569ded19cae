"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word extends
keeping that period, at least ``least`` words and ``times * q`` long. The word ids of a batch of texts are
compressed by Re-Pair (see ``re_pair``). A run in a text lies whole in the smallest nonterminal around it and
crosses the boundary of its two children, so:

1. Each distinct nonterminal of enough words is looked at once, at one place where it stands. At least half of
   a run lies on one side of the boundary, so some words at the boundary come again one period away: the
   places of equal short word sequences give the periods to try.
2. Common extensions to both sides, by binary search on sums of word hashes, give the runs across the
   boundary within the nonterminal; of equal stretches the smallest period stays.
3. The runs are translated to every place where the nonterminal stands.
4. Of the intervals of one period in a text, those inside another one go: what is left is maximal. Each is
   compared word by word at the end.

Words are compared by 64-bit hashes. Texts are read whole, a few megabytes at a time; a longer text is a batch of
its own. Nothing is shuffled.

Defined results: a null or empty text has no words, no runs, and becomes the empty text; every row is a
document, so repeated ids do not matter; an empty table gives an empty result. All columns pass through but
those named ``runs`` and ``strongest``; ``text`` becomes the words kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import words as W
from flowlens.llm.re_pair import grammar
from flowlens.session import ship_by_value

LEAST, TIMES = 24, 3
#: bytes of texts that share a grammar
BLOCK_BYTES = 3 << 20
#: pairs of places compared together
PAIRS = 1 << 20

_RUN = "struct<start:long,length:long,period:long>"
_KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Extensions:
    """Longest common extensions of two places, from prefix sums of word hashes times powers."""

    def __init__(self, words: np.ndarray):
        self.powers = np.full(len(words) + 1, 0xD6E8FEB86659FD93, dtype=np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.powers[:-1], out=self.sums[1:])

    def _same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        left = (self.sums[i + n] - self.sums[i]) * self.powers[j - i]
        return left == self.sums[j + n] - self.sums[j]

    def longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Equal words from ``i`` and ``j > i`` on, or right before them, ``most`` at the most."""
        low, high = np.zeros(len(i), dtype=np.int64), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            n = (low + high + 1) // 2
            same = self._same(i - n, j - n, n) if back else self._same(i, j, n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low


class _Places:
    """Places of equal word sequences of one text, in order."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, width: int):
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        grams = W.sequence_hashes(words, width)
        at = np.flatnonzero(text[: len(grams)] == text[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
        keys = grams[at] + W.mixed(text[at].astype(np.uint64))
        by = np.argsort(keys, kind="stable")
        self.order, keys = at[by], keys[by]
        self.number = np.full(len(words), -1)
        self.number[self.order] = np.arange(len(self.order))
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.group = np.cumsum(new) - 1
        # places ascend in this key, group by group
        self.base = len(words) + 1
        self.key = self.group * self.base + self.order

    def between(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``at``, the range of numbers of its equals at places from ``low`` to ``high``."""
        own = self.number[at]
        base = self.group[own] * self.base
        first = np.searchsorted(self.key, base + np.maximum(low, 0))
        last = np.searchsorted(self.key, base + np.maximum(high, -1), side="right")
        return first, np.maximum(first, last)


def _crossing(
    start: np.ndarray, middle: np.ndarray, end: np.ndarray, places: _Places, same: _Extensions,
    width: int, least: int, times: int,
) -> Iterator[tuple[np.ndarray, ...]]:
    """Node numbers, first and last bounds and periods of runs across the nodes' boundaries."""
    size = end - start
    for right in (True, False):
        at = middle if right else middle - width
        far = size // times
        low, high = (at + 1, np.minimum(at + far, end - width)) if right else (np.maximum(at - far, start), at - 1)
        node = np.flatnonzero((at >= start) & (at + width <= end) & (low <= high))
        node = node[places.number[at[node]] >= 0]
        first, last = places.between(at[node], low[node], high[node])
        some = last > first
        node, first, many = node[some], first[some], (last - first)[some]
        # bounded shares of the pairs of places; a node's own pairs are at most a third of its words
        share = np.concatenate([[0], np.cumsum(many)]) // PAIRS
        for k in np.unique(share[:-1]):
            mine = share[:-1] == k
            n = np.repeat(node[mine], many[mine])
            number = np.repeat(first[mine], many[mine]) + (
                np.arange(len(n)) - np.repeat(np.cumsum(many[mine]) - many[mine], many[mine])
            )
            period = np.abs(places.order[number] - at[n])
            i = middle[n] if right else middle[n] - period
            a = i - same.longest(i, i + period, i - start[n], back=True)
            b = i + period + same.longest(i, i + period, end[n] - i - period)
            good = b - a >= np.maximum(least, times * period)
            yield n[good], a[good], b[good], period[good]


def _maximal(text: np.ndarray, a: np.ndarray, b: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Numbers of the intervals that lie in no other of the same text and period."""
    by = np.lexsort((-b, a, period, text))
    text, a, b, period = text[by], a[by], b[by], period[by]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (period[1:] != period[:-1])])
    group = np.cumsum(new) - 1
    # the farthest end so far, kept apart for each group by a large step
    step = int(b.max()) + 1
    reach = np.maximum.accumulate(group * step + b)
    inside = np.concatenate([[False], reach[:-1] >= (group * step + b)[1:]])
    return by[~inside | new]


def find(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows of text number, first word in the batch, length and period, by text, start and period."""
    if times < 3:
        raise ValueError("runs are found from three periods on")
    nothing = np.zeros((0, 4), dtype=np.int64)
    if not len(words):
        return nothing
    nodes = grammar(words, bounds, least)
    symbols, one, kind = np.unique(nodes.symbol, return_index=True, return_inverse=True)
    width = max(1, least * (times - 2) // (2 * times))
    places, same = _Places(words, bounds, width), _Extensions(W.mixed(words))
    start, end = nodes.start[one], (nodes.start + nodes.size)[one]
    parts = _crossing(start, start + nodes.left[one], end, places, same, width, least, times)
    found = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 4
    node, a, b, period = found
    if not len(node):
        return nothing
    by = np.lexsort((period, b, a, node))
    node, a, b, period = node[by], a[by], b[by], period[by]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    node, a, b, period = node[new], a[new], b[new], period[new]
    # every place of a node with runs
    here = np.flatnonzero(np.isin(kind, node))
    here = here[np.argsort(kind[here], kind="stable")]
    first, last = (np.searchsorted(kind[here], node, side=s) for s in ("left", "right"))
    many = last - first
    run = np.repeat(np.arange(len(node)), many)
    place = here[np.repeat(first, many) + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)]
    shift = nodes.start[place] - start[node[run]]
    a, b, period = a[run] + shift, b[run] + shift, period[run]
    text = np.searchsorted(bounds, a, side="right") - 1
    keep = _maximal(text, a, b, period)
    keep = keep[[bool((words[x : y - q] == words[x + q : y]).all()) for x, y, q in zip(a[keep], b[keep], period[keep], strict=True)]]
    out = np.stack([text[keep], a[keep], b[keep] - a[keep], period[keep]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1]))]


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Marks of the ``n`` words that no run holds after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 1] + runs[:, 3], 1)
    np.add.at(steps, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(steps[:-1]) == 0


def joined(data: np.ndarray, words: W.Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every text's kept words with one space between, and the texts' bounds in them."""
    counts = np.concatenate([[0], np.cumsum(kept)])[words.bounds]
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    # each word's bytes, then a space in place of what follows it
    index = np.arange(place[-1]) + np.repeat(starts - place[:-1], sizes + 1)
    out = np.append(data, np.uint8(32))[index]
    out[place[1:] - 1] = 32
    bounds = place[counts]
    filled = np.diff(counts) > 0
    last = np.zeros(len(out), dtype=bool)
    last[bounds[1:][filled] - 1] = True  # no space after a text's last word
    return out[~last], bounds - np.concatenate([[0], np.cumsum(filled)])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length in periods; ties by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with each run's repeats cut out of ``text``, and ``runs`` and ``strongest``.

    ``runs`` holds start, length (both in words, from 0) and period of every run in order; ``strongest`` is the
    one of most periods, or null.
    """
    kept = [c for c in docs.columns if c.lower() not in ("runs", "strongest")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    added = T.StructType.fromDDL(f"runs array<{_RUN}>, strongest {_RUN}")
    at = [c.lower() for c in kept].index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = W.column_bytes(batch.column(at))
            for first, last in W.blocks(bounds, BLOCK_BYTES):
                own = data[bounds[first] : bounds[last]]
                words = W.split(own, bounds[first : last + 1] - bounds[first], W.NOT_SPACE)
                runs = find(W.hashes(own, words), words.bounds, least, times)
                texts, ends = joined(own, words, kept_words(runs, len(words.starts)))
                each: list[list] = [[] for _ in range(last - first)]
                for text, start, length, period in runs.tolist():
                    each[text].append((start - int(words.bounds[text]), length, period))
                names = _KIND.names
                out = [c.slice(first, last - first) for c in batch.columns]
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), last - first, [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(texts)]
                )
                out[at] = column.cast(pa.binary()).cast(pa.string())
                out.append(pa.array([[dict(zip(names, r, strict=True)) for r in x] for x in each], pa.list_(_KIND)))
                best = [strongest(x) for x in each]
                out.append(pa.array([r and dict(zip(names, r, strict=True)) for r in best], _KIND))
                yield pa.RecordBatch.from_arrays(out, [*kept, "runs", "strongest"])

    return frame.mapInArrow(task, T.StructType([*frame.schema, *added]))


ship_by_value(__name__)
