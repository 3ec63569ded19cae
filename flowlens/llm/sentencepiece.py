"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A block of texts is cut before every run of spaces, and its distinct cuts ("words") are laid end to
end. A suffix array over these bytes gives, by binary search, the range of suffixes that start with
each vocabulary piece, and so every edge (start, end, piece) of every word at once. Edges are sorted
by end and relaxed in that order: the last piece of a prefix is the one edge whose piece may follow
the last piece at its start. Two pieces may follow each other if merging their text gives the same
two pieces, which their merge histories decide. The result equals merging by score, left to right.

No piece of the vocabulary may hold a space after another character; runs of spaces are pieces of
their own and are merged last. ``Vocabulary.load`` checks both. Characters without a piece become
their bytes. As in the model's own normaliser, a space is put in front of every text that is not
empty and U+2581 counts as a space, so a text with that character is the one kind that does not
decode to itself.

Defined results: null and empty texts have no pieces (null decodes to the empty text); repeated rows
are encoded each; an empty table gives an empty result. ``encode`` keeps all other columns, and
replaces one that has the result's name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import words as W
from flowlens.session import ship_by_value

#: text encoded at once; about forty times as much memory while it is
BLOCK_BYTES = 2 << 20
#: words a task remembers with their pieces
KNOWN_WORDS = 1 << 19
#: remembered answers whether a piece may follow another
REMEMBERED = 1 << 20

# ---- fixed values of the model format ---------------------------------------------------
NORMAL, BYTE = 1, 6
_MARK = "▁"

_BREAK = 0xFF  # no UTF-8 text holds this byte
_LEAF = -1


class Vocabulary(NamedTuple):
    """Pieces as arrays. Pieces that merging never makes are left out of ``matched``."""

    text: np.ndarray  # bytes of all pieces as decoded, spaces for marks
    cuts: np.ndarray  # piece i is text[cuts[i]:cuts[i + 1]]
    bytes_: np.ndarray  # ids of the 256 byte pieces
    matched: np.ndarray  # ids of pieces to look for
    rank: np.ndarray  # order of the merge that makes a piece, -1 for single characters
    left: np.ndarray  # the two pieces of that merge, the piece itself for single characters
    right: np.ndarray
    pairs: np.ndarray  # sorted left << 32 | right of all merges
    merged: np.ndarray  # rank of the merge of each pair
    space: int  # id of the single space
    runs: dict[int, float]  # scores of the runs of spaces by length
    run_ids: dict[int, int]

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        """Read the pieces of a serialised model."""
        pieces = _pieces(model)
        own = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(_MARK, " ").encode()
            for p, _, kind in pieces
        ]
        ids = {p.replace(_MARK, " "): i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        for p in ids:
            if " " in p[1:] and p.strip(" "):
                raise ValueError(f"a piece holds a space after another character: {p!r}")
        runs = {len(p): pieces[i][1] for p, i in ids.items() if not p.strip(" ")}
        lowest = min((pieces[i][1] for p, i in ids.items() if p.strip(" ") and len(p) > 1), default=0)
        if any(s >= lowest for k, s in runs.items() if k > 1):
            raise ValueError("runs of spaces must merge after all other pieces")
        words = {p: i for p, i in ids.items() if len(p) == 1 or p.strip(" ")}
        if any(c not in words for p in words for c in p):
            raise ValueError("every character of a piece must be a piece")
        order = sorted((p for p in words if len(p) > 1), key=lambda p: -pieces[words[p]][1])
        rank = np.full(len(pieces), _LEAF, dtype=np.int64)
        rank[[words[p] for p in order]] = np.arange(len(order))
        left = np.arange(len(pieces))
        right = left.copy()
        matched, pairs = [], {}
        for p, i in words.items():
            last = _last_merge(p, words, rank)
            if last is not None:
                matched.append(i)
                left[i], right[i] = words[p[: last]] if last else i, words[p[last:]] if last else i
            for k in range(1, len(p)):
                a, b = words.get(p[:k]), words.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank[i]
        keys = np.array(sorted(pairs), dtype=np.int64)
        byte_ids = np.full(256, -1, dtype=np.int64)
        for i, (_, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[own[i][0]] = i
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        return cls(
            text=np.frombuffer(b"".join(own), dtype=np.uint8),
            cuts=np.concatenate([[0], np.cumsum([len(x) for x in own])]),
            bytes_=byte_ids,
            matched=np.array(sorted(matched), dtype=np.int64),
            rank=rank,
            left=left,
            right=right,
            pairs=keys,
            merged=np.array([pairs[k] for k in keys.tolist()], dtype=np.int64),
            space=words[" "],
            runs=runs,
            run_ids={len(p): i for p, i in ids.items() if not p.strip(" ")},
        )


def _pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and kind of every vocabulary entry, and a check of the model's settings."""
    import sentencepiece as library

    found = library.SentencePieceProcessor(model_proto=model)
    kinds = [
        BYTE if found.is_byte(i) else 0 if found.is_control(i) or found.is_unknown(i) else NORMAL
        for i in range(found.vocab_size())
    ]
    return [(found.id_to_piece(i), found.get_score(i), k) for i, k in enumerate(kinds)]


def _last_merge(piece: str, words: dict[str, int], rank: np.ndarray) -> int | None:
    """Where the last merge of the piece's text joins, 0 for a character, None if never made."""
    parts, joint = list(piece), 0
    while len(parts) > 1:
        joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
        options = [(rank[words[x]], i) for i, x in enumerate(joined) if x in words]
        if not options:
            return None
        best = min(options)
        joint = len(parts[best[1]])
        parts[best[1] : best[1] + 2] = [joined[best[1]]]
    return joint


def spaces(n: int, scores: dict[int, float]) -> list[int]:
    """Lengths of the pieces that a run of ``n`` spaces is merged into."""
    size, following = [1] * n, list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i]
        if j < n and size[i] + size[j] in scores:
            heapq.heappush(queue, (-scores[size[i] + size[j]], i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = following[i]
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j], following[i] = a + b, 0, following[j]
        if following[j] < n:
            before[following[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in size if x]


class Encoder:
    """Encodes blocks of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        sizes = np.diff(vocabulary.cuts)[vocabulary.matched]
        self.sizes = sizes
        padded = np.zeros(len(vocabulary.text) + 64, dtype=np.uint8)
        padded[: len(vocabulary.text)] = vocabulary.text
        at = vocabulary.cuts[:-1][vocabulary.matched]
        chunks = -(-int(sizes.max()) // 8)
        view = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
        #: bytes of the pieces in steps of eight, with the least and greatest continuation
        self.low, self.high = [], []
        for c in range(chunks):
            left = np.clip(sizes - 8 * c, 0, 8).astype(np.uint64)
            word = view[np.minimum(at + 8 * c, len(view) - 1)].astype(np.uint64)
            free = np.where(
                left == 8, np.uint64(0), np.uint64(2**64 - 1) >> (np.uint64(8) * np.minimum(left, 7))
            )
            self.low.append(word & ~free)
            self.high.append(word | free)
        self.known = np.full(REMEMBERED, -1, dtype=np.int64)
        self.answer = np.zeros(REMEMBERED, dtype=bool)
        self.spaces: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        #: hashes of the words seen so far, ascending, and their pieces
        self.keys = np.zeros(0, dtype=np.uint64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.cuts = np.zeros(1, dtype=np.int64)

    def _remember(self, keys: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> None:
        """Add words that are not known yet."""
        size = np.concatenate([np.diff(self.cuts), np.diff(cuts)])
        begin = np.concatenate([self.cuts[:-1], cuts[:-1] + len(self.ids)])
        every, both = np.concatenate([self.keys, keys]), np.concatenate([self.ids, ids])
        by = np.argsort(every, kind="stable")
        self.keys, self.cuts = every[by], np.concatenate([[0], np.cumsum(size[by])])
        self.ids = both[np.repeat(begin[by] - self.cuts[:-1], size[by]) + np.arange(self.cuts[-1])]

    # ---- matching ----------------------------------------------------------------------

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in ``data``."""
        padded = np.full(len(data) + 8 * len(self.low) + 8, _BREAK, dtype=np.uint8)
        padded[: len(data)] = data
        chunk = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
        first = chunk[: len(data)].astype(np.uint64)
        order = np.argsort(first, kind="stable")
        keys = first[order]
        # suffixes alike so far are sorted by their next bytes, if a longer piece may match them
        place = np.arange(len(order))
        for c in range(1, len(self.low)):
            same = np.zeros(len(place) + 1, dtype=bool)
            same[1:-1] = keys[1:] == keys[:-1]
            tied = same[:-1] | same[1:]
            group = np.cumsum(~same[:-1])[tied]
            place = place[tied]
            if not len(place):
                break
            after = chunk[order[place] + 8 * c].astype(np.uint64)
            by = np.lexsort((after, group))
            order[place] = order[place][by]
            pairs = np.stack([group[by], after[by].view(np.int64)], axis=1)
            fresh = np.ones(len(pairs), dtype=bool)
            fresh[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            keys = np.cumsum(fresh)
        low = np.searchsorted(first[order], self.low[0], side="left")
        high = np.searchsorted(first[order], self.high[0], side="right")
        for c in range(1, len(self.low)):
            longer = np.flatnonzero((self.sizes > 8 * c) & (high > low))
            ends = [
                self._bisect(chunk, order, low[longer], high[longer], target[longer], 8 * c, right)
                for target, right in ((self.low[c], False), (self.high[c], True))
            ]
            low[longer], high[longer] = ends
        found = high - low
        rows = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
        return order[rows].astype(np.int32), np.repeat(self.v.matched.astype(np.int32), found)

    @staticmethod
    def _bisect(chunk, order, low, high, target, skip: int, right: bool) -> np.ndarray:
        """First place in each range whose suffix has at ``skip`` no smaller (or a greater) chunk."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            value = chunk[order[middle] + skip].astype(np.uint64)
            before = value <= target[open_] if right else value < target[open_]
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        return low

    # ---- which piece may follow which --------------------------------------------------

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of ``a`` and ``b`` gives ``a`` and ``b`` again.

        Undoes the merges of both sides, the latest first; in between, the two pieces at the seam
        must not have an earlier merge of their own.
        """
        v = self.v
        out = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        open_ = np.arange(len(a))
        while len(open_):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
            bad = (v.pairs[at] == key) & (v.merged[at] < limit)
            out[open_[bad]] = False
            ra, rb = v.rank[a], v.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            open_, a, b, ra, rb = open_[on], a[on], b[on], ra[on], rb[on]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a = np.where(undo_left, v.right[a], a)
            b = np.where(undo_left, b, v.left[b])
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_follows`` with a fixed-size memory; characters without a piece follow anything."""
        out = np.ones(len(a), dtype=bool)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[both].astype(np.int64) << 32 | b[both]
        slot = (W.mixed(key.view(np.uint64)) % np.uint64(REMEMBERED)).astype(np.int64)
        known = self.known[slot] == key
        out[both[known]] = self.answer[slot[known]]
        new, slot, both = key[~known], slot[~known], both[~known]
        if len(new):
            kinds, at = np.unique(new, return_inverse=True)
            out[both] = self._follows(kinds >> 32, kinds & 0xFFFFFFFF)[at]
            self.known[slot], self.answer[slot] = new, out[both]
            clash = self.known[slot] != new  # another key of this call took the slot
            if clash.any():
                kept = np.flatnonzero(~clash)
                self.answer[slot[kept]] = out[both[kept]]
        return out

    # ---- words -------------------------------------------------------------------------

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Pieces of words (bytes with at most one space, in front) as ids and bounds."""
        sizes = ends - starts
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = np.full(at[-1], _BREAK, dtype=np.uint8)
        inside = np.ones(at[-1], dtype=bool)
        inside[at[1:] - 1] = False
        source = np.repeat(starts - at[:-1], sizes + 1) + np.arange(at[-1])
        joined[inside] = data[source[inside]]
        start, piece = self.edges(joined)
        end = start + np.diff(self.v.cuts).astype(np.int32)[piece]
        # a character without a piece of its own is an edge with a negative piece
        heads = np.flatnonzero(inside & ((joined & 0xC0) != 0x80))
        width = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int32)[joined[heads]]
        single = np.zeros(len(joined) + 1, dtype=bool)
        single[start[self.v.rank[piece] == _LEAF]] = True
        lone = heads[~single[heads]]
        lone_width = width[~single[heads]]
        start = np.concatenate([start, lone.astype(np.int32)])
        end = np.concatenate([end, lone.astype(np.int32) + lone_width])
        piece = np.concatenate([piece, -lone_width])
        base = np.repeat(at[:-1].astype(np.int32), sizes + 1)
        offset = (end - 1 - base[start]).astype(np.int32)
        by = np.argsort(offset, kind="stable")
        start, end, piece, offset = start[by], end[by], piece[by], offset[by]
        last = np.full(len(joined) + 1, np.iinfo(np.int32).min, dtype=np.int32)
        begins = np.zeros(len(joined) + 1, dtype=bool)
        begins[at[:-1]] = True
        levels = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1]])) if len(offset) else []
        for a, z in zip(levels, [*levels[1:], len(offset)], strict=True):
            s, p = start[a:z], piece[a:z]
            fits = begins[s]
            rest = np.flatnonzero(~fits)
            fits[rest] = self.follows(last[s[rest]], p[rest])
            last[end[a:z][fits]] = p[fits]
        return self._walk_back(joined, at, sizes, last)

    def _walk_back(self, joined, at, sizes, last):
        """Pieces of every word from the last pieces of its prefixes, in order."""
        lengths = np.diff(self.v.cuts)
        byte_ids = self.v.bytes_.astype(np.int32)
        where, which = at[:-1] + sizes, np.arange(len(sizes))
        out_word, out_place, out_id = [], [], []
        open_ = np.flatnonzero(sizes > 0)
        where, which = where[open_], which[open_]
        while len(which):
            piece = last[where]
            width = np.where(piece < 0, -piece, lengths[piece])
            for back in range(1, int(width[piece < 0].max(initial=0)) + 1):
                own = np.flatnonzero((piece < 0) & (width >= back))
                out_word.append(which[own])
                out_place.append(where[own] - back)
                out_id.append(byte_ids[joined[where[own] - back]])
            own = np.flatnonzero(piece >= 0)
            where = where - width
            out_word.append(which[own])
            out_place.append(where[own])
            out_id.append(piece[own])
            on = where > at[which]
            where, which = where[on], which[on]
        place = np.concatenate([np.zeros(0, np.int64), *out_place])
        by = np.argsort(place, kind="stable")
        ids = np.concatenate([np.zeros(0, np.int32), *out_id])[by]
        word = np.concatenate([np.zeros(0, np.int64), *out_word])[by]
        return ids, np.searchsorted(word, np.arange(len(sizes) + 1))

    # ---- texts -------------------------------------------------------------------------

    def _run(self, n: int) -> np.ndarray:
        if n not in self.spaces:
            sizes = spaces(n, self.v.runs)
            self.spaces[n] = np.array([self.v.run_ids[k] for k in sizes], dtype=np.int32)
        return self.spaces[n]

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's bounds."""
        data, bounds = prepared(data, bounds)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        space = data == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(opens)
        ends = np.concatenate([starts[1:], [len(data)]])
        run = np.add.reduceat(space.astype(np.int64), starts)  # the spaces in front of each word
        words = W.Words(starts + run - 1, ends, bounds)
        key = W.hashes(data, words)
        kinds, first = np.unique(key, return_index=True)
        if len(self.keys) + len(kinds) > KNOWN_WORDS:
            self._forget()
        new = np.ones(len(kinds), dtype=bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
            new = self.keys[at] != kinds
        if new.any():
            own = first[new]
            self._remember(kinds[new], *self.words(data, words.starts[own], words.ends[own]))
        number = np.searchsorted(self.keys, key)
        ids = self.ids
        size = np.diff(self.cuts)[number]
        begin = self.cuts[:-1][number]
        several = np.flatnonzero(run > 1)
        if len(several):
            return self._with_runs(ids, begin, size, run, starts, bounds)
        total = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, bounds)]

    def _with_runs(self, ids, begin, size, run, starts, bounds):
        """As ``texts``, where some words have several spaces in front."""
        lone = ids[begin] == self.v.space  # the space stays apart from the word and joins the run
        extra = np.where(run > 1, run - np.where(lone, 0, 1), 0)
        skip = ((run > 1) & lone).astype(np.int64)
        lengths = {int(k): self._run(int(k)) for k in np.unique(extra[extra > 0])}
        front = np.zeros(len(run), dtype=np.int64)
        for k, pieces in lengths.items():
            front[extra == k] = len(pieces)
        size = size - skip
        total = np.concatenate([[0], np.cumsum(front + size)])
        flat = np.empty(total[-1], dtype=np.int32)
        place = np.repeat(total[:-1] + front - (np.cumsum(size) - size), size) + np.arange(size.sum())
        source = np.repeat(begin + skip - (np.cumsum(size) - size), size) + np.arange(size.sum())
        flat[place] = ids[source]
        for k, pieces in lengths.items():
            at = total[:-1][extra == k]
            flat[(at[:, None] + np.arange(len(pieces))).ravel()] = np.tile(pieces, len(at))
        return flat, total[np.searchsorted(starts, bounds)]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts with these ids, without the space in front."""
        sizes = np.diff(self.v.cuts)[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        begin = np.repeat(self.v.cuts[:-1][ids] - total[:-1], sizes)
        out = self.v.text[begin + np.arange(total[-1])]
        cuts = total[bounds]
        first = cuts[:-1][np.diff(cuts) > 0]
        first = first[out[first] == 0x20]
        keep = np.ones(len(out), dtype=bool)
        keep[first] = False
        return out[keep], cuts - np.searchsorted(first, cuts)


def prepared(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the vocabulary sees them: marks as spaces, a space before every text."""
    mark = np.frombuffer(_MARK.encode(), dtype=np.uint8)
    found = np.flatnonzero(data == mark[0])
    found = found[(found + 2 < len(data))]
    found = found[(data[found + 1] == mark[1]) & (data[found + 2] == mark[2])]
    if len(found):
        keep = np.ones(len(data), dtype=bool)
        keep[found + 1] = keep[found + 2] = False
        data = data.copy()
        data[found] = 0x20
        bounds = bounds - 2 * np.searchsorted(found, bounds)
        data = data[keep]
    full = np.diff(bounds) > 0
    data = np.insert(data, bounds[:-1][full], 0x20)
    return data, bounds + np.concatenate([[0], np.cumsum(full)])


def encode(docs: DataFrame, model: bytes, column: str = "text", to: str = "pieces") -> DataFrame:
    """All columns of ``docs`` and ``to``, the piece ids of ``column``."""
    return _mapped(docs, model, column, to, T.ArrayType(T.IntegerType()), _encoded)


def _encoded(encoder: Encoder, column: pa.Array) -> pa.Array:
    data, bounds = W.column_bytes(column)
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b in W.blocks(bounds, BLOCK_BYTES):
        ids, cuts = encoder.texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        parts.append(ids)
        sizes.append(np.diff(cuts))
    cuts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts)))


def decode(docs: DataFrame, model: bytes, column: str = "pieces", to: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and ``to``, the text of the piece ids in ``column``."""
    return _mapped(docs, model, column, to, T.StringType(), _decoded)


def _decoded(encoder: Encoder, column: pa.Array) -> pa.Array:
    ids = column.flatten().to_numpy()
    sizes = column.value_lengths().fill_null(0).to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    parts = []
    for a, b in W.blocks(bounds, BLOCK_BYTES // 4):
        data, cuts = encoder.decoded(ids[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        buffers = [pa.py_buffer(x.tobytes()) for x in (cuts.astype(np.int32), data)]
        parts.append(pa.StringArray.from_buffers(b - a, *buffers))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _mapped(docs: DataFrame, model: bytes, column: str, to: str, kind: T.DataType, work) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept = [c for c in docs.columns if c.lower() != to.lower() or c == column]
    input_ = docs.select(*[F.col(f"`{c}`") for c in kept])
    out = [c for c in kept if c.lower() != to.lower()]
    schema = input_.select(*[F.col(f"`{c}`") for c in out]).schema
    schema = T.StructType([*schema, T.StructField(to, kind)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(held.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in out], work(encoder, batch[column])], [*out, to]
            )

    return input_.mapInArrow(task, schema)


ship_by_value(__name__)
