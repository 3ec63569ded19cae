"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product, the sum of the scores of ``fragments`` runs of components. Every
fragment has its list of local scores for a query; the lists of a shard of rows lie together, so no
local score crosses the network. Three phases:

1. *Gather.* Each list gives its ``k`` highest local scores, and the rows they name are summed up.
   The ``k``-th best sum over all shards is a safe cutoff, for as many rows reach it.
2. *Collect.* Blocks of queries go out again with their cutoffs. A row whose local scores are all
   below ``cutoff / fragments`` stays below the cutoff, so each list gives its entries from there on.
3. *Resolve.* The sums of the collected rows are exact; those that reach the cutoff are kept, and the
   best ``k`` of each query come out of a merge of all shards.

Sums are exact: floats up to 2 ** 52, longs beyond. Blocks of queries and shards have a bounded size,
and every pair of them is a group of two rows; no side is broadcast.

Defined results: a null vector, one with a null or non-finite component and one too long for scores
of 64 bits take no part (see ``vector_blocks.whole``); a shorter vector counts as padded with zeros;
rows that share an id are rows of their own, and only the query's own row is left out; null ids come
after all others and are returned as null; an empty table, or one without queries, gives an empty
result. Only ``vec_id`` and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vector_blocks as V
from flowlens.session import ship_by_value, store

K = 10
FRAGMENTS = 4
#: queries whose score matrices are in memory together
STRIPE = 128
RESULT = "query_id long, rank int, vec_id long, score long"


def scores_by_fragment(x: np.ndarray, y: np.ndarray, fragments: int) -> list[np.ndarray]:
    """Local scores of all pairs, a matrix for each run of components."""
    cuts = np.linspace(0, x.shape[1], fragments + 1).astype(int)
    return [x[:, a:b] @ y[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


def gathered(lists: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Marks of the rows that are among the ``k`` highest of some list, without the query's own."""
    marks = np.zeros(own.shape, dtype=bool)
    for scores in lists:
        scores = np.where(own, scores.min(initial=0) - 1, scores)
        if scores.shape[1] > k:
            top = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
            np.put_along_axis(marks, top, True, axis=1)
        else:
            marks[:] = True
    return marks & ~own


def collected(lists: list[np.ndarray], own: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """Marks of the rows with a local score of at least an equal share of the cutoff."""
    share = -(-cutoffs // len(lists))
    marks = np.zeros(own.shape, dtype=bool)
    for scores in lists:
        marks |= scores >= share[:, None]
    return marks & ~own


def _finder(k: int, fragments: int, phase: str):
    """``find`` of ``vector_blocks.meet`` for the first phase, or the two others."""

    def find(block: pa.Table, shard: pa.Table):
        queries, rows = V.unpack(block), V.unpack(shard)
        x, y = V.alike(queries, rows)
        if phase == "collect":
            cutoffs = np.full(len(x), -(2**62), dtype=np.int64)
            slots, scores = V.entries(block, "slots", "scores")
            last = V.rank(slots) == k - 1
            cutoffs[slots[last]] = scores[last]
        found = []
        for first in range(0, len(x), STRIPE):
            some = slice(first, first + STRIPE)
            lists = scores_by_fragment(x[some], y, fragments)
            own = queries.rows[some, None] == rows.rows[None, :]
            marks = gathered(lists, own, k) if phase == "gather" else collected(lists, own, cutoffs[some])
            q, r = np.nonzero(marks)
            sums = sum(scores[q, r] for scores in lists).astype(np.int64)
            if phase == "collect":
                reach = sums >= cutoffs[some][q]
                q, r, sums = q[reach], r[reach], sums[reach]
            found.append(V.best(q + first, sums, rows.ids[r], k))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    return find


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    vector: str = "embedding",
    scale: float = 1024,
    fragments: int = FRAGMENTS,
    shard: int = V.SHARD,
    block: int = V.BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows with the highest inner products.

    ``is_query`` picks the query rows by the columns of ``vectors``; candidates are all other rows.
    Components are scaled and floored first. Ties go to the smaller ``vec_id``.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(V.LAST)).alias("id"),
        F.lit(0).cast("long").alias("label"),
        V.whole(F.col(f"`{vector}`"), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = store(rows.where("vector is not null"), "search-rows")
    count, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = max(1, -(-count // shard)), max(1, -(-asking // block))
    shards = store(V.pack(rows, n_shards), "search-shards")
    queries = store(V.pack(rows.where("asks"), n_blocks), "search-queries")

    first = V.meet(queries, shards, n_blocks, n_shards, _finder(k, fragments, "gather"))
    known = V.merged(first, n_shards, k).select(F.col("block").alias("part"), "slots", "scores")
    rest = V.meet(queries.join(known, "part", "left"), shards, n_blocks, n_shards, _finder(k, fragments, "collect"))

    def ranked(table: pa.Table, block_: pa.Table) -> pa.Table:
        slots, scores, ids = V.entries(table, "slots", "scores", "ids")
        asks = np.frombuffer(block_["ids"][0].as_py(), "<i8")
        return pa.table(
            {
                "query_id": named(asks[slots]),
                "rank": pa.array(V.rank(slots) + 1, pa.int32()),
                "vec_id": named(ids),
                "score": pa.array(scores, pa.int64()),
            }
        )

    left = V.merged(rest, n_shards, k).groupBy("block")
    right = queries.withColumnRenamed("part", "block").groupBy("block")
    return left.cogroup(right).applyInArrow(ranked, RESULT)


def named(ids: np.ndarray) -> pa.Array:
    """Ids with nulls back in their places."""
    return pa.array(ids, pa.int64(), mask=ids == V.LAST)


ship_by_value(__name__)
