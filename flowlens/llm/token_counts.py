"""Unigram token counts with one dynamic program over the trie of all distinct pre-tokens.

A pre-token is a word (a run of anything but white space) with a space in front. The distinct
pre-tokens of a block of texts form a trie of bytes. Every node has the score of the best way to cut
its prefix into vocabulary pieces and the number of pieces, worked out once however many pre-tokens
share it, a level of the trie at a time: the partial matches of a node are those of its parent, one
byte further in the vocabulary's own trie. A document's count adds up the counts at its pre-tokens'
ends.

The score of a cut is the sum of its pieces' scores; of equally good cuts the one with fewer pieces
counts. A byte that no piece covers is a piece of its own with a score below all others. Defined
results: null and empty texts have no tokens; repeated rows are counted each; an empty table gives
an empty result. All columns pass through, but for those that have the names of the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import words as W
from flowlens.session import ship_by_value

BLOCK_BYTES = 6 << 20
#: how much worse than the worst piece a single byte is
BYTE_PENALTY = 10.0


def zipf_scores(pieces: list[str]) -> dict[bytes, float]:
    """Log probabilities by rank, for a vocabulary that has an order but no probabilities."""
    return {p.encode(): -log(rank + 2) for rank, p in enumerate(pieces)}


def ranked_pieces(model: bytes) -> list[str]:
    """Pieces of a SentencePiece model from best to worst, marks as spaces, without runs of spaces."""
    import sentencepiece as library

    found = library.SentencePieceProcessor(model_proto=model)
    ids = [
        i
        for i in range(found.vocab_size())
        if not (found.is_byte(i) or found.is_control(i) or found.is_unknown(i))
    ]
    ids.sort(key=lambda i: (-found.get_score(i), i))
    pieces = [found.id_to_piece(i).replace("▁", " ") for i in ids]
    return [p for p in pieces if len(p) == 1 or p.strip(" ")]


class Pieces:
    """Vocabulary as a trie of bytes in sorted arrays."""

    def __init__(self, scores: dict[bytes, float]):
        states, steps, ends = {b"": 0}, {}, {}
        for piece, score in scores.items():
            for k in range(len(piece)):
                if piece[: k + 1] not in states:
                    states[piece[: k + 1]] = len(states)
                    steps[states[piece[:k]] << 8 | piece[k]] = states[piece[: k + 1]]
            ends[states[piece]] = score
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int64)
        self.score = np.full(len(states), np.nan)
        self.score[list(ends)] = list(ends.values())
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """Following states, -1 where no piece goes on."""
        if not len(self.keys):
            return np.full(len(states), -1)
        key = states << 8 | bytes_
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


def counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Pieces of every distinct pre-token, given as byte ranges of words without the space."""
    # a level's nodes follow those of the level above; node 0 is the root
    best, number = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
    size = ends - starts + 1
    out = np.zeros(len(starts), dtype=np.int64)
    words, node = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    first, total = 0, 1  # of the level above, and nodes so far
    # partial matches of the level above, in node order: state and the node where the match began
    bounds, state, origin = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = 0
    while len(words):
        byte = np.full(len(words), 0x20, dtype=np.int64)
        if depth:
            byte = data[starts[words] + depth - 1].astype(np.int64)
        kinds, child = np.unique((node - first) << 8 | byte, return_inverse=True)
        parent, byte = (kinds >> 8) + first, kinds & 255
        # a child's matches: its parent's, and one that begins at the parent
        many = np.diff(bounds)[parent - first] + 1
        place = np.repeat(np.arange(len(kinds)), many)
        base = np.cumsum(many) - many
        inner = np.arange(many.sum()) - base[place]
        new = inner == many[place] - 1
        source = np.where(new, 0, bounds[parent[place] - first] + inner)
        now = np.zeros(len(place), dtype=np.int64)
        begun = parent[place].copy()
        now[~new], begun[~new] = state[source[~new]], origin[source[~new]]
        now = pieces.step(now, byte[place])
        on = now >= 0
        place, state, origin = place[on], now[on], begun[on]
        bounds = np.searchsorted(place, np.arange(len(kinds) + 1))
        scores, numbers = np.concatenate(best), np.concatenate(number)
        whole = ~np.isnan(pieces.score[state])
        options = np.concatenate([scores[origin[whole]] + pieces.score[state[whole]], scores[parent] + pieces.byte])
        taken = np.concatenate([numbers[origin[whole]] + 1, numbers[parent] + 1])
        owner = np.concatenate([place[whole], np.arange(len(kinds))])
        by = np.lexsort((taken, -options, owner))
        lead = by[np.searchsorted(owner[by], np.arange(len(kinds)))]
        best = [scores, options[lead]]
        number = [numbers, taken[lead]]
        first, total = total, total + len(kinds)
        depth += 1
        done = size[words] == depth
        out[words[done]] = taken[lead][child[done]]
        words, node = words[~done], child[~done] + first
    return out


def count_tokens(docs: DataFrame, scores: dict[bytes, float]) -> DataFrame:
    """All columns of ``docs``, ``n_pretokens`` and ``n_tokens`` of ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(scores)
    names = ["n_pretokens", "n_tokens"]
    kept = [c for c in docs.columns if c.lower() not in names]
    input_ = docs.select(*[F.col(f"`{c}`") for c in kept])

    def block(data: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        words = W.split(data, bounds, W.NOT_SPACE)
        key = W.hashes(data, words)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        own = counts(data, words.starts[first], words.ends[first], pieces)
        total = np.concatenate([[0], np.cumsum(own[which])])
        return np.diff(words.bounds), total[words.bounds[1:]] - total[words.bounds[:-1]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            pieces = pieces or Pieces(held.value)
            data, bounds = W.column_bytes(batch.column(kept.index("text")))
            found = [
                block(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], pieces)
                for a, b in W.blocks(bounds, BLOCK_BYTES)
            ]
            sums = [np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(s, pa.int64()) for s in sums]], [*kept, *names]
            )

    added = T.StructType.fromDDL("n_pretokens long, n_tokens long")
    return input_.mapInArrow(task, T.StructType([*input_.schema, *added]))


ship_by_value(__name__)
