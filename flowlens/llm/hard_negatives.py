"""Hard negatives within windows of score, by bounds along a spanning tree of anchors.

Anchors are dealt to blocks, alike ones together, and each block's anchors are joined by a minimum
spanning tree over their distances. For a row ``c`` and neighbouring anchors ``p`` and ``a``, the scores
differ by ``|(a - p) . c|``, at most the edge's length times the norm of ``c``. So from the intervals of
scores at a parent, widened by that, follow those at its child, and only rows that matter are scored:

1. *Positives*: rows of the anchor's label whose interval reaches the ``positives``-th highest lower
   end. The best of each shard are merged.
2. *Negatives*: rows of other labels whose interval overlaps the window of a positive and reaches the
   ``negatives``-th highest lower end among the rows that surely lie in the window.

Scores found this way are exact and replace the intervals; where more than half of a shard's rows
matter, all are scored. Bounds only leave out rows that cannot be in the result, so it is that of a full
comparison, at any distance of the anchors. Blocks and shards have a bounded size and meet in groups of two
packed rows (see ``vector_blocks``); nothing is broadcast.

Defined results: a row with a null label or a vector that takes no part (null, or with a null or
non-finite component, or too long for scores of 64 bits) is left out; a shorter vector counts as padded
with zeros; rows that share an id are rows of their own, an anchor being no positive of itself only;
null ids come after all others and are returned as null; a window without rows, or an anchor without
positives, gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vector_blocks as V
from flowlens.llm.topk_search import named
from flowlens.session import ship_by_value, store

POSITIVES, NEGATIVES = 5, 3
#: the window of a positive's score, in percent of it
LOW, HIGH = 50, 95
#: anchors of a block; a block's intervals take 16 bytes for every anchor and row of a shard
BLOCK = 512
#: components whose signs bring alike anchors together
SIGNS = 32
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Points in the order of a minimum spanning tree, each with its parent and distance; the root's is -1."""
    points = points.astype(np.float64)
    nearest = np.full(len(points), np.inf)
    parent = np.full(len(points), -1)
    left = np.ones(len(points), dtype=bool)
    out = []
    for _ in range(len(points)):
        at = int(np.argmin(np.where(left, nearest, np.inf))) if out else 0
        out.append((at, int(parent[at]), float(nearest[at]) if out else 0.0))
        left[at] = False
        far = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = left & (far < nearest)
        nearest[closer], parent[closer] = far[closer], at
    return out


class Bounds:
    """Intervals of the scores of a shard's rows at the anchors of a block, parents before children."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        self.anchors, self.rows = anchors, rows
        self.norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9
        self.tree = spanning_tree(anchors)
        self.children = np.bincount([p for _, p, _ in self.tree if p >= 0], minlength=len(anchors))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor with the lower and upper ends of its scores, which the caller may narrow."""
        for a, parent, distance in self.tree:
            reach = float(np.sqrt((self.anchors[a].astype(np.float64) ** 2).sum())) * self.norms * (1 + 1e-9) + 1
            low, high = -reach, reach
            if parent >= 0:
                wide = distance * (1 + 1e-9) * self.norms + 1e-3 + 1e-12 * reach
                low = np.maximum(low, self.known[parent][0] - wide)
                high = np.minimum(high, self.known[parent][1] + wide)
                self.children[parent] -= 1
                if not self.children[parent]:
                    del self.known[parent]
            else:
                low[:] = high[:] = self.rows @ self.anchors[a]
            yield a, low, high
            if self.children[a]:
                self.known[a] = (low, high)

    def score(
        self, a: int, need: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact scores of the rows needed; both their ends become those scores."""
        at = np.flatnonzero(need)
        if 2 * len(at) > len(need):
            scores = self.rows @ self.anchors[a]
            low[:] = high[:] = scores
            scores = scores[at]
        else:
            scores = self.rows[at] @ self.anchors[a]
            low[at] = high[at] = scores
        return at, scores.astype(np.int64)


def _least(low: np.ndarray, most: int) -> float:
    """The ``most``-th highest of the values, or no bound if there are fewer."""
    return -np.inf if len(low) < most else np.partition(low, len(low) - most)[len(low) - most]


def _find_positives(most: int):
    def find(block: pa.Table, shard: pa.Table):
        anchors, rows = V.unpack(block), V.unpack(shard)
        bounds = Bounds(*V.alike(anchors, rows))
        found = [[np.zeros(0, np.int64)] * 3]
        for a, low, high in bounds:
            mine = (rows.labels == anchors.labels[a]) & (rows.rows != anchors.rows[a])
            at, scores = bounds.score(a, mine & (high >= _least(low[mine], most)), low, high)
            found.append(V.best(np.full(len(at), a), scores, rows.ids[at], most))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    return find


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score of positives' scores."""
    hundreds, rest = np.divmod(scores, 100)
    return low * hundreds - (-low * rest // 100), high * hundreds + high * rest // 100


def _find_negatives(positives: int, most: int, share: tuple[int, int]):
    def find(block: pa.Table, shard: pa.Table):
        anchors, rows = V.unpack(block), V.unpack(shard)
        slots, scores = V.entries(block, "slots", "scores")
        first, last = windows(scores, *share)
        place = V.rank(slots)
        cuts = np.searchsorted(slots, np.arange(len(anchors.rows) + 1))
        bounds = Bounds(*V.alike(anchors, rows))
        found = [[np.zeros(0, np.int64)] * 3]
        for a, low, high in bounds:
            other = rows.labels != anchors.labels[a]
            need = np.zeros(len(other), dtype=bool)
            own = range(cuts[a], cuts[a + 1])
            for i in own:
                over = other & (low <= last[i]) & (high >= first[i])
                inside = low[over & (low >= first[i]) & (high <= last[i])]
                need |= over & (high >= _least(inside, most))
            at, exact = bounds.score(a, need, low, high)
            ids = rows.ids[at]
            for i in own:
                some = (exact >= first[i]) & (exact <= last[i])
                slot = np.full(int(some.sum()), a * positives + place[i])
                found.append(V.best(slot, exact[some], ids[some], most))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    return find


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    vector: str = "embedding",
    scale: float = 256,
    shard: int = V.SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    An anchor's positives are its ``positives`` best rows of the same ``label``; a positive's negatives
    are the ``negatives`` best rows of other labels whose scores lie from ``low`` to ``high`` percent of the
    positive's. Ties go to the smaller ``vec_id``. Components are scaled and floored first.
    """
    whole = V.whole(F.col(f"`{vector}`"), scale)
    rows = vectors.where("label is not null").select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(V.LAST)).alias("id"),
        F.col("label").cast("long").alias("label"),
        whole.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = store(rows.where("vector is not null"), "mining-rows")
    count, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = max(1, -(-count // shard)), max(1, -(-asking // block))
    shards = store(V.pack(rows, n_shards), "mining-shards")
    signs = F.transform(F.slice("vector", 1, SIGNS), lambda x: F.when(x < 0, "0").otherwise("1"))
    asked = rows.where("asks").withColumn("signs", F.array_join(signs, ""))
    anchors = store(V.pack(asked, n_blocks, "signs"), "mining-anchors")

    found = V.meet(anchors, shards, n_blocks, n_shards, _find_positives(positives))
    best = store(V.merged(found, n_shards, positives), "mining-positives")
    known = best.select(F.col("block").alias("part"), "slots", "scores")
    finder = _find_negatives(positives, negatives, (low, high))
    hard = V.meet(anchors.join(known, "part"), shards, n_blocks, n_shards, finder)
    hard = V.merged(hard, n_shards, negatives)

    ends = anchors.select(F.col("part").alias("block"), F.col("ids").alias("anchor_ids")).join(
        best.select("block", *[F.col(c).alias(f"positive_{c}") for c in ("slots", "scores", "ids")]), "block"
    )

    def rows_of(table: pa.Table, anchor: pa.Table) -> pa.Table:
        slots, scores, ids = V.entries(table, "slots", "scores", "ids")
        anchor_ids, p_slots, p_scores, p_ids = V.entries(
            anchor, "anchor_ids", "positive_slots", "positive_scores", "positive_ids"
        )
        at = np.searchsorted(p_slots * positives + V.rank(p_slots), slots)
        return pa.table(
            {
                "anchor_id": named(anchor_ids[slots // positives]),
                "positive_id": named(p_ids[at]),
                "rank": pa.array(V.rank(slots) + 1, pa.int32()),
                "negative_id": named(ids),
                "positive_score": pa.array(p_scores[at], pa.int64()),
                "negative_score": pa.array(scores, pa.int64()),
            }
        )

    return hard.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(rows_of, RESULT)


ship_by_value(__name__)
