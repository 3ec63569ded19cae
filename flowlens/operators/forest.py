"""Random forest whose trees are grown, stored and asked by tasks, so that no tree comes to the driver.

It grows what Spark's ``RandomForestClassifier`` grows by default: bootstrap rows by Poisson counts, thresholds
at 32 bins of a feature's values, a fresh draw of ``ceil(sqrt(features))`` features for each node, Gini gain on
weighted rows, no least size of a leaf, and leaves of one parent that predict alike merged. Trees vote with
their leaf's class shares.

Spark's own fit keeps every node of every tree in the driver, whose one generator draws for all of them. Here a
tree has a generator of its own, seeded by (seed, tree), and sees the training rows in the order of their
content: a tree does not depend on partitions, cores or the trees it is grown with. A task takes ``GROUP`` trees
and holds the training rows as one byte for each feature; votes meet in blocks of distinct rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ship_by_value, store

ship_by_value(__name__)

BINS = 32
#: trees that a task grows or asks; fixed, so that votes are added in one order everywhere
GROUP = 10
#: rows whose cells of (node, feature, bin) are counted together
CHUNK = 1 << 15
#: distinct rows that go through the groups of trees as one
BLOCK = 2048
EPSILON = 2.0**-52
TREES = "tree int, feature binary, bin binary, child binary, stats binary"
VOTES = "block string, part int, bins binary, votes binary"


# ---- thresholds and bins -------------------------------------------------------------------
def thresholds(values: np.ndarray, weights: np.ndarray) -> list[float]:
    """Cuts between sorted distinct values: all of them, or ``BINS - 1`` that part the weight evenly."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < BINS:
        return middles.tolist()
    stride = weights.sum() / BINS
    cuts, target = [], stride
    reached = np.cumsum(weights)
    for middle, before, after in zip(middles.tolist(), reached[:-1].tolist(), reached[1:].tolist(), strict=True):
        if abs(before - target) < abs(after - target):
            cuts.append(middle)
            target += stride
    return cuts[: BINS - 1]


def find_thresholds(rows: DataFrame, kinds: list[tuple[float, float]]) -> list[list[float]]:
    """Cuts of every feature of ``rows`` (values, kind). Rows are counted by value first."""

    def cuts(table: pa.Table) -> pa.Table:
        value, kind, n = (table[c].to_numpy() for c in ("value", "kind", "n"))
        order = np.lexsort((kind, value))
        distinct, first = np.unique(value[order], return_index=True)
        weights = np.add.reduceat(np.array([w for _, w in kinds])[kind[order]] * n[order], first)
        found = pa.array([thresholds(distinct, weights)], pa.list_(pa.float64()))
        return pa.table({"feature": table["feature"][:1], "cuts": found})

    counted = rows.select("kind", F.posexplode("values").alias("feature", "value"))
    counted = counted.groupBy("feature", "value", "kind").agg(F.count("*").alias("n"))
    found = counted.groupBy("feature").applyInArrow(cuts, "feature int, cuts array<double>").collect()
    return [list(r["cuts"]) for r in sorted(found, key=lambda r: r["feature"])]


def matrix(values: pa.Array, features: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def binned(values: np.ndarray, splits: list[list[float]]) -> np.ndarray:
    """A byte for each value: the number of cuts below it."""
    bins = np.empty(values.shape, dtype=np.uint8)
    for i, cuts in enumerate(splits):
        bins[:, i] = np.searchsorted(np.array(cuts), values[:, i], side="left")
    return bins


# ---- one tree ------------------------------------------------------------------------------
def class_sums(counts: np.ndarray, kinds: list[tuple[float, float]], classes: int) -> np.ndarray:
    """Weighted rows of each class from rows of each kind (class, weight)."""
    sums = np.zeros((len(counts), classes))
    for k, (label, weight) in enumerate(kinds):
        sums[:, int(label)] += counts[:, k] * weight
    return sums


def gini(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and weight of each row of class sums."""
    total = np.zeros(len(sums))
    for c in range(sums.shape[1]):
        total += sums[:, c]
    impurity = np.ones(len(sums))
    for c in range(sums.shape[1]):
        share = sums[:, c] / total
        impurity -= share * share
    return impurity, total


def split_chunk(bins, kind, count, rows, node, features, totals, kinds, classes):
    """For each node of a chunk the gain, feature and bin of its best cut, and the rows of each kind left of it.

    Only cells that hold rows are judged: a cut at an empty bin parts the rows as the one before it.
    """
    nodes, tried = features.shape
    slots = np.arange(tried)

    def cells_of(first: int) -> np.ndarray:
        some = slice(first, first + CHUNK)
        drawn = bins[rows[some, None], features[node[some]]]
        return ((node[some, None] * tried + slots) * BINS + drawn).ravel()

    full = np.zeros(nodes * tried * BINS, dtype=bool)
    for first in range(0, len(rows), CHUNK):
        full[cells_of(first)] = True
    cells = np.flatnonzero(full)
    place = np.cumsum(full) - 1
    held = np.zeros(len(cells) * len(kinds))
    for first in range(0, len(rows), CHUNK):
        some = rows[first : first + CHUNK]
        at = place[cells_of(first)] * len(kinds) + np.repeat(kind[some], tried)
        held += np.bincount(at, np.repeat(count[some], tried), len(held))
    # counts are whole numbers, so that sums and differences are exact
    upto = np.cumsum(held.reshape(-1, len(kinds)), axis=0)
    slot = cells // BINS
    begins = np.flatnonzero(np.diff(slot, prepend=-1))
    ahead = np.vstack([np.zeros(len(kinds)), upto[begins[1:] - 1]])
    left = upto - np.repeat(ahead, np.diff(begins, append=len(cells)), axis=0)
    owner = slot // tried
    right = totals[owner] - left
    gain = np.full(len(cells), -np.inf)
    cut = np.flatnonzero(right.sum(axis=1) > 0)
    impurity, _ = gini(class_sums(totals, kinds, classes))
    (below, a), (above, b) = (gini(class_sums(x[cut], kinds, classes)) for x in (left, right))
    gain[cut] = impurity[owner[cut]] - a / (a + b) * below - b / (a + b) * above
    best = np.maximum.reduceat(gain, np.flatnonzero(np.diff(owner, prepend=-1)))
    hits = np.flatnonzero(gain == best[owner])
    hits = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]  # the first of equal ones
    return best, features[owner[hits], slot[hits] % tried], cells[hits] % BINS, left[hits]


def chunks(node: np.ndarray, nodes: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of nodes of about ``CHUNK`` rows: first and last node, first and last row. ``node`` is sorted."""
    starts = np.searchsorted(node, np.arange(nodes + 1))
    first = 0
    while first < nodes:
        last = max(int(np.searchsorted(starts, starts[first] + CHUNK, side="right")) - 1, first + 1)
        yield first, last, int(starts[first]), int(starts[last])
        first = last


def grow(bins, kind, count, kinds, classes, tried, depth, draw):
    """Feature, bin and first child of each node and the class sums of each leaf.

    ``draw(nodes)`` gives the features tried by each of a level's nodes. A leaf's child is -1 less its number.
    """
    rows, node = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64)
    totals = np.bincount(kind, count, len(kinds)).reshape(1, -1)
    levels, size = [], 0
    for level in range(depth + 1):
        sums = class_sums(totals, kinds, classes)
        feature, cut = np.zeros(len(sums), dtype=np.int16), np.zeros(len(sums), dtype=np.uint8)
        child = np.full(len(sums), -1, dtype=np.int64)
        wide = np.flatnonzero(np.abs(gini(sums)[0]) >= EPSILON) if level < depth else np.empty(0, dtype=np.int64)
        levels.append((feature, cut, child, sums))
        size += len(sums)
        if not len(wide):
            break
        number = np.full(len(sums), -1)
        number[wide] = np.arange(len(wide))
        node = number[node]
        rows, node = rows[node >= 0], node[node >= 0]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        features, parts = draw(len(wide)), []
        for a, b, first, last in chunks(node, len(wide)):
            mine = rows[first:last], node[first:last] - a, features[a:b], totals[wide[a:b]]
            parts.append(split_chunk(bins, kind, count, *mine, kinds, classes))
        gain, best, at, left = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = np.flatnonzero(gain > 0)
        if not len(good):
            break
        parents = wide[good]
        feature[parents], cut[parents] = best[good], at[good]
        child[parents] = size + 2 * np.arange(len(good))
        totals = np.stack([left[good], totals[parents] - left[good]], axis=1).reshape(-1, len(kinds))
        number = np.full(len(wide), -1)
        number[good] = np.arange(len(good))
        parent = number[node]
        rows, node, parent = rows[parent >= 0], node[parent >= 0], parent[parent >= 0]
        node = 2 * parent + (bins[rows, best[node]] > at[node])
    return merged(*(np.concatenate(x) for x in zip(*levels, strict=True)))


def merged(feature, cut, child, sums):
    """The tree without leaves that predict as their only sibling, a leaf too; nodes numbered anew from the root."""
    says = sums.argmax(axis=1)
    parents = np.flatnonzero(child >= 0)
    while len(parents):  # from below; a parent's children lie behind it
        a = child[parents]
        same = (child[a] < 0) & (child[a + 1] < 0) & (says[a] == says[a + 1])
        if not same.any():
            break
        child[parents[same]] = -1
        parents = parents[~same]
    kept = [np.zeros(1, dtype=np.int64)]
    while len(inner := kept[-1][child[kept[-1]] >= 0]):
        kept.append((child[inner][:, None] + np.arange(2)).ravel())
    nodes = np.concatenate(kept)
    number = np.full(len(child), -1)
    number[nodes] = np.arange(len(nodes))
    leaf = child[nodes] < 0
    children = np.where(leaf, -np.cumsum(leaf), number[child[nodes]]).astype(np.int32)
    return feature[nodes], cut[nodes], children, sums[nodes[leaf]]


def shares(tree: dict, bins: np.ndarray, classes: int) -> np.ndarray:
    """Class shares of the leaf that each row reaches."""
    feature, cut = np.frombuffer(tree["feature"], dtype=np.int16), np.frombuffer(tree["bin"], dtype=np.uint8)
    child = np.frombuffer(tree["child"], dtype=np.int32)
    stats = np.frombuffer(tree["stats"]).reshape(-1, classes)
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(rows := rows[child[at[rows]] >= 0]):
        here = at[rows]
        at[rows] = child[here] + (bins[rows, feature[here]] > cut[here])
    return (stats / stats.sum(axis=1, keepdims=True))[-1 - child[at]]


# ---- tasks ---------------------------------------------------------------------------------
def as_batch(rows: list[dict], columns: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(
        rows, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in columns.split(", "))])
    )


def pack_rows(splits: list[list[float]]):
    """``mapInArrow`` function: rows (values, kind) to blocks of bytes, a row's kind in its last four."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(matrix(batch["values"], len(splits)), splits)
            kind = batch["kind"].to_numpy().astype(np.int32).reshape(-1, 1)
            yield as_batch([{"rows": np.hstack([bins, kind.view(np.uint8)]).tobytes()}], "rows binary")

    return pack


def grow_groups(features, kinds, classes, trees, depth, seed, tried, bootstrap):
    """``mapInArrow`` function: blocks of training rows, sorted by group, to each group's trees."""

    def grown(group: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(blocks), dtype=np.dtype((np.void, features + 4)))
        distinct, times = np.unique(rows, return_counts=True)
        parts = distinct.view(np.uint8).reshape(-1, features + 4)
        bins = np.ascontiguousarray(parts[:, :features])
        kind = np.ascontiguousarray(parts[:, features:]).view(np.int32).ravel()
        for tree in range(group * GROUP, min(trees, (group + 1) * GROUP)):
            source = np.random.default_rng([seed, tree])
            # the sum of the Poisson counts of equal rows
            count = source.poisson(times) if bootstrap else times
            drawn = count > 0
            if not drawn.any():
                drawn, count = np.ones(len(times), dtype=bool), times

            def draw(nodes: int, source=source) -> np.ndarray:
                if tried == features:
                    return np.broadcast_to(np.arange(features), (nodes, features))
                return source.random((nodes, features)).argsort(axis=1)[:, :tried]

            found = grow(bins[drawn], kind[drawn], count[drawn], kinds, classes, tried, depth, draw)
            names = ("feature", "bin", "child", "stats")
            yield as_batch([{"tree": tree, **{n: x.tobytes() for n, x in zip(names, found, strict=True)}}], TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks = None, []
        for batch in batches:
            for g, rows in zip(batch["group"].to_pylist(), batch["rows"].to_pylist(), strict=True):
                if g != group and blocks:
                    yield from grown(group, blocks)
                    blocks = []
                group = g
                blocks.append(rows)
        if blocks:
            yield from grown(group, blocks)

    return run


def pack_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of bytes to blocks, named by their content."""
    import hashlib

    for batch in batches:
        rows = batch["bins"].to_pylist()
        for first in range(0, len(rows), BLOCK):
            whole = b"".join(rows[first : first + BLOCK])
            yield as_batch([{"block": hashlib.sha256(whole).hexdigest(), "bins": whole}], "block string, bins binary")


def ask_groups(features: int, classes: int):
    """``mapInArrow`` function: a group's trees and then the blocks, to the sum of its trees' shares by block.

    The first group's rows carry the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    group, trees = row["group"], []
                if row["tree"] is not None:
                    trees.append(row)
                    continue
                bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, features)
                votes = np.zeros((len(bins), classes))
                for tree in trees:
                    votes += shares(tree, bins, classes)
                carried = row["bins"] if group == 0 else None
                yield as_batch([{"block": row["block"], "part": group, "bins": carried, "votes": votes.tobytes()}], VOTES)

    return run


def add_votes(features: int, classes: int):
    """``mapInArrow`` function: the groups' votes on each block, in order, to the probabilities of its rows."""

    def told(bins: bytes, votes: np.ndarray) -> pa.RecordBatch:
        rows = [bins[i : i + features] for i in range(0, len(bins), features)]
        shown = votes / votes.sum(axis=1, keepdims=True)
        return pa.RecordBatch.from_pydict({"_bins": pa.array(rows, pa.binary()), "_shares": list(shown)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bins, votes = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                more = np.frombuffer(row["votes"]).reshape(-1, classes)
                if row["block"] == block:
                    votes = votes + more
                    continue
                if block is not None:
                    yield told(bins, votes)
                block, bins, votes = row["block"], row["bins"], more
        if block is not None:
            yield told(bins, votes)

    return run


def to_bins(splits: list[list[float]]):
    def one(values: pa.Array) -> pa.Array:
        bins = binned(matrix(values, len(splits)), splits)
        return pa.array([row.tobytes() for row in bins], pa.binary())

    return F.arrow_udf(one, "binary")


# ---- estimator and model -------------------------------------------------------------------
class Forest(Estimator):
    """Fits ``ForestModel`` to the columns features, label_index and weight. ``tried``: features for each node."""

    def __init__(self, trees: int, depth: int, seed: int, tried: int | None = None, bootstrap: bool = True):
        super().__init__()
        self.trees, self.depth, self.seed, self.tried, self.bootstrap = trees, depth, seed, tried, bootstrap

    def _fit(self, dataset: DataFrame) -> ForestModel:
        found = dataset.groupBy("label_index", "weight").agg(F.count("*")).collect()  # one for each class
        kinds = sorted((r["label_index"], r["weight"]) for r in found)
        classes = int(kinds[-1][0]) + 1
        branches = [
            F.when((F.col("label_index") == label) & (F.col("weight") == weight), F.lit(k))
            for k, (label, weight) in enumerate(kinds)
        ]
        rows = dataset.select(vector_to_array("features").alias("values"), F.coalesce(*branches).alias("kind"))
        splits = find_thresholds(rows, kinds)
        tried = self.tried or int(np.ceil(np.sqrt(len(splits))))
        task = grow_groups(
            len(splits), kinds, classes, self.trees, self.depth, self.seed, tried, self.bootstrap
        )
        blocks = rows.mapInArrow(pack_rows(splits), "rows binary")
        grown = in_groups(blocks.select(each_group(self.trees), "rows"), self.trees).mapInArrow(task, TREES)
        return ForestModel(store(grown, "trees"), splits, classes, self.trees, self.depth)


def each_group(trees: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // GROUP))).alias("group")


def in_groups(rows: DataFrame, trees: int, *order: str) -> DataFrame:
    """``rows`` in as many tasks as there are groups of trees, each group's together."""
    return rows.repartition(-(-trees // GROUP), "group").sortWithinPartitions("group", *order)


class ForestModel(Model, MLWritable, MLReadable):
    """Trees as rows of a stored table. ``transform`` adds the column ``probability`` to rows with features."""

    def __init__(self, trees: DataFrame, splits: list[list[float]], classes: int, count: int, depth: int):
        super().__init__()
        self.trees, self.splits, self.classes, self.count, self.depth = trees, splits, classes, count, depth

    @property
    def getNumTrees(self) -> int:
        return self.count

    def getMaxDepth(self) -> int:
        return self.depth

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows are stored, for they are read twice: for their distinct bins, and to get the votes on these."""
        features = len(self.splits)
        known = store(dataset.withColumn("_bins", to_bins(self.splits)(vector_to_array("features"))), "binned")
        blocks = known.select(F.col("_bins").alias("bins")).distinct().mapInArrow(pack_bins, "block string, bins binary")
        trees = self.trees.withColumn("group", (F.col("tree") / GROUP).cast("int"))
        met = trees.unionByName(blocks.select(each_group(self.count), "*"), allowMissingColumns=True)
        met = in_groups(met, self.count, F.col("tree").asc_nulls_last())
        votes = met.mapInArrow(ask_groups(features, self.classes), VOTES)
        votes = votes.repartition("block").sortWithinPartitions("block", "part")
        told = votes.mapInArrow(add_votes(features, self.classes), "_bins binary, _shares array<double>")
        joined = known.join(told, "_bins").withColumn("probability", array_to_vector("_shares"))
        return joined.select(*dataset.columns, "probability")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        facts = {"splits": self.model.splits, "classes": self.model.classes, "trees": self.model.count, "depth": self.model.depth}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=facts)
        self.model.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark: SparkSession = self.sparkSession
        told = DefaultParamsReader.loadMetadata(path, spark)
        trees = spark.read.schema(TREES).parquet(f"{path}/trees")
        loaded = ForestModel(trees, told["splits"], told["classes"], told["trees"], told["depth"])
        loaded._resetUid(told["uid"])
        return loaded
