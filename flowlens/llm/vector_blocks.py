"""Whole-number vectors in shards, met by blocks of query vectors.

Rows are numbered and stored once. Shards of rows and blocks of queries are single rows that hold
packed arrays; every block meets every shard in one group of two such rows, whatever the data look
like, so no key is hot. What a group finds is packed as well, and merged block by block in a tree of
bounded fan-in, each step keeping the best entries of a slot only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_by_value

#: rows of a shard, queries of a block, packed results that meet in one group
SHARD, BLOCK, FAN = 4096, 2048, 64

LAST = 2**63 - 1  # stands for a null id
_PACK = "part long, n long, rows binary, ids binary, labels binary, vectors binary"
FOUND = "block long, part long, slots binary, scores binary, ids binary"


def whole(vector: Column, scale: float) -> Column:
    """Floor of every scaled component, as longs; null for a vector that takes no part.

    That is a null one, one with a null or non-finite component, and one whose squared length is
    2 ** 62 or more, since its scores may not fit a long.
    """
    each = vector.cast("array<double>")
    finite = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    longs = F.transform(each, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    square = F.aggregate(
        each, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(scale)) * x).cast("double"), 2)
    )
    return F.when(finite & (square < 2.0**62), longs)


def pack(rows: DataFrame, parts: int, *near: str) -> DataFrame:
    """Rows dealt evenly to ``parts``, one packed row each; ``near`` columns keep alike rows together.

    ``rows`` holds ``row``, ``id``, ``label`` and ``vector``, an array of longs.
    """
    dealt = rows.repartitionByRange(parts, *near, "row") if near else rows.repartition(parts)

    def task(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lists = table["vector"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        matrix = np.zeros((len(sizes), int(sizes.max())), dtype=np.int64)
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = flat
        small = not matrix.size or np.abs(matrix).max() < 2**31
        row, id_, label = (
            pa.array([np.ascontiguousarray(table[c].to_numpy(), dtype="<i8").tobytes()], pa.binary())
            for c in ("row", "id", "label")
        )
        yield pa.RecordBatch.from_arrays(
            [
                table["part"].combine_chunks()[:1],
                pa.array([len(sizes)]),
                row,
                id_,
                label,
                pa.array([matrix.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                pa.array([matrix.shape[1]]),
            ],
            ["part", "n", "rows", "ids", "labels", "vectors", "dims"],
        )

    numbered = dealt.select(F.spark_partition_id().cast("long").alias("part"), "row", "id", "label", "vector")
    return numbered.mapInArrow(task, _PACK + ", dims long")


class Pack(NamedTuple):
    """Rows of a shard or block as arrays; vectors as exact floats, or longs where those are not exact."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def unpack(table: pa.Table) -> Pack:
    n, dims = table["n"][0].as_py(), table["dims"][0].as_py()
    raw = table["vectors"][0].as_py()
    kind = "<i8" if len(raw) == 8 * n * dims and n * dims else "<i4"
    row, id_, label = (np.frombuffer(table[c][0].as_py(), "<i8") for c in ("rows", "ids", "labels"))
    return Pack(row, id_, label, np.frombuffer(raw, kind).reshape(n, dims).astype(np.int64))


def alike(a: Pack, b: Pack) -> tuple[np.ndarray, np.ndarray]:
    """The two sides' vectors, with zeros where one is shorter, in a type whose products are exact."""
    dims = max(a.vectors.shape[1], b.vectors.shape[1])
    x, y = (
        np.pad(v, ((0, 0), (0, dims - v.shape[1]))) if v.shape[1] < dims else v
        for v in (a.vectors, b.vectors)
    )
    longest = [float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for v in (x, y)]
    return (x.astype(np.float64), y.astype(np.float64)) if longest[0] * longest[1] < 2.0**52 else (x, y)


def meet(blocks: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int, find: Callable) -> DataFrame:
    """What ``find(block, shard)`` finds in every pair, packed, with ``part`` numbering fan-in groups.

    ``find`` gets the two packed rows as tables and returns slots, scores and ids.
    """

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = blocks.withColumnRenamed("part", "block").withColumn("shard", every(n_shards))
    right = shards.withColumnRenamed("part", "shard").withColumn("block", every(n_blocks))

    def task(block: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(block) or not len(shard):
            return packed(None, 0, *[np.zeros(0, np.int64)] * 3)
        return packed(block["block"][0].as_py(), shard["shard"][0].as_py() // FAN, *find(block, shard))

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(task, FOUND)


def packed(block, part, slots, scores, ids) -> pa.Table:
    some = [0] if len(slots) else []
    values = [np.ascontiguousarray(x, dtype="<i8").tobytes() for x in (slots, scores, ids)]
    columns = [pa.array([block for _ in some], pa.int64()), pa.array([part for _ in some], pa.int64())]
    columns += [pa.array([x for _ in some], pa.binary()) for x in values]
    return pa.Table.from_arrays(columns, ["block", "part", "slots", "scores", "ids"])


def entries(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of all packed rows of the table, laid end to end; a null holds nothing."""
    return [np.frombuffer(b"".join(x or b"" for x in table[c].to_pylist()), "<i8") for c in names]


def best(slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """The ``most`` highest entries of every slot, ties by smaller id, in that order."""
    by = np.lexsort((ids, -scores, slots))
    slots, scores, ids = slots[by], scores[by], ids[by]
    keep = rank(slots) < most
    return [slots[keep], scores[keep], ids[keep]]


def rank(slots: np.ndarray) -> np.ndarray:
    """Place of each entry in its slot; equal slots lie together."""
    first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else slots
    return np.arange(len(slots)) - np.repeat(first, np.diff(np.append(first, len(slots))))


def merged(found: DataFrame, n_shards: int, most: int) -> DataFrame:
    """One packed row a block with the ``most`` best entries of every slot."""

    def task(table: pa.Table) -> pa.Table:
        kept = best(*entries(table, "slots", "scores", "ids"), most)
        return packed(table["block"][0].as_py(), table["part"][0].as_py() // FAN, *kept)

    parts = -(-n_shards // FAN)
    while True:
        found = found.groupBy("block", "part").applyInArrow(task, FOUND)
        if parts == 1:
            return found
        parts = -(-parts // FAN)


ship_by_value(__name__)
