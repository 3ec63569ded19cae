"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_by_value, store

ROUNDS = 100
#: links that a task joins at once before the first round
CHUNK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes that some links connect to a smaller one, and the smallest that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        for side in (label[x], label[y]):
            np.minimum.at(label, side, low)
        while (label[label] != label).any():
            label = label[label]
    leaves = label != np.arange(len(nodes))
    return nodes[leaves], nodes[label[leaves]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links as the stars that each ``CHUNK`` of them forms."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*ends)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has either one edge to a smaller node or edges to larger ones only."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"))
    ends = ends.union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return not nodes.agg(F.max(F.col("ups") > F.col("low"))).first()[0]


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that links reach; a label's own node is left out.

    ``links`` has the columns ``a`` and ``b``; order, repeats and loops do not matter. Tasks first
    join what they hold, a chunk at a time, so that few links need no round. Every round
    is a stored table of at most as many edges as the one before, so no lineage builds up. Nodes
    with many links meet joins whose other side has one row a node, which skew handling can split.
    """
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = links.select(*ends).where("a <> b").distinct()
    edges = store(links.mapInArrow(_contracted, "a long, b long"), "edges")
    for _ in range(ROUNDS):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = small.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = store(stars, "edges")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


ship_by_value(__name__)
