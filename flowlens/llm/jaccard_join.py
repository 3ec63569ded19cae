"""N-gram Jaccard join by prefix trees, and the components that its links form.

Every document's set of word n-grams is put in one global order, frequent n-grams last. Documents
that hold the same set are one class, known by its smallest ``doc_id``. Two sets as similar as
asked share a number of n-grams among the first ones of each (the prefix bound), so:

1. ``describe`` reads all texts for set sizes, set digests and the documents of every n-gram, by
   its first 32 bits; the most frequent of those, ``FREQUENT_MOST`` at most, go last in the order.
   The choice touches speed only.
2. ``prefixes`` deals the first n-grams of every class to buckets and keeps those of two classes or
   more.
3. Some classes of each n-gram's group, the same for most n-grams of near copies, lead. Members that
   share enough with a leader are probed against it, and the links join near copies into components
   without listing the pairs of a group. Groups that stay apart get other leaders, a few times.
4. Components that still share enough first n-grams are probed against each other. Where an n-gram is
   left with many, its place in a set's order says how much of the set comes from there on, and so which
   sizes of another set can still reach the overlap: classes meet in cells of two bands of sizes that
   allow each other, and only cells with two components are probed, in blocks.

A probe stores one side's ordered sets in a prefix tree and walks it with a set of the other side:
partial overlaps are shared along common starts, and a subtree is left as soon as the n-grams that
remain cannot reach the overlap asked for. All links between different components are found.

Defined results: a null or empty text has the empty set and links with nothing; fewer words than
``width`` make one n-gram of the whole; rows that share a ``doc_id`` count as one document for
links; null ids together are one document after all others (component null unless linked to an id);
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import words as W
from flowlens.llm.components import connected
from flowlens.llm.prefix_tree import PrefixTree
from flowlens.session import arrow_rows, ship_by_value, store

WIDTH = 5
PERCENT = 75
#: share of a set, in percent, that its first n-grams have in common with those of a linked set; a
#: greater share makes more first n-grams and fewer candidates
SHARED = 10
#: n-grams found in more documents than this go last in the order
FREQUENT = 16
#: leaders of a group of more classes than FREQUENT, and how often such groups get new ones
LEADERS, ROUNDS = 6, 3
#: components of an n-gram that are paired off; of n-grams with more, classes meet by size
PAIRED = 64
#: classes of a crowded n-gram meet by bands of size, each this many percent wide
BAND = 5
#: classes of an n-gram that meet in one bucket; more are dealt to several
TOGETHER = 1 << 18
#: at most so many of them (12 MB for each task)
FREQUENT_MOST = 1 << 20
#: texts whose sets are built together; about twenty times as much memory meanwhile
BLOCK_BYTES = 1 << 20
#: texts that go to a task's Python side at once
BATCH_ROWS = 1 << 10
#: n-grams a task holds before it deals them out
HELD = 1 << 19
#: buckets at the least; more where a bucket would hold more than BUCKET n-grams
BUCKETS, BUCKET = 256, 1 << 19
#: sets of a tree, and sets walked through it, in one group
TREE, PROBES = 128, 128

LAST = 2**63 - 1  # stands for a null id
_HALF = np.uint64(1)
_TOP = np.uint64(1 << 63)


def grams_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of a text in the column and its distinct n-grams as sorted 63-bit hashes."""
    data, bounds = W.column_bytes(column)
    for a, b in W.blocks(bounds, BLOCK_BYTES):
        low = W.LOWER[data[bounds[a] : bounds[b]]]
        words = W.split(low, bounds[a : b + 1] - bounds[a], W.NOT_SPACE)
        hashes = W.hashes(low, words)
        runs = W.sequence_hashes(hashes, width) >> _HALF
        for i in range(b - a):
            first, end = words.bounds[i], words.bounds[i + 1]
            if end - first >= width:
                yield a + i, np.unique(runs[first : end - width + 1])
            elif end > first:
                whole = W.sequence_hashes(hashes[first:end], int(end - first))
                yield a + i, W.mixed(whole + np.uint64(end - first)) >> _HALF
            else:
                yield a + i, runs[:0]


def _head(grams: np.ndarray) -> np.ndarray:
    """First 32 bits of n-grams, whether they carry the mark of frequent ones or not."""
    return ((grams & ~_TOP) >> np.uint64(31)).astype(np.uint32)


def _times(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Documents of the n-grams that are frequent, 0 for others."""
    heads, counts = frequent
    if not len(heads):
        return np.zeros(len(grams), dtype=np.int64)
    own = _head(grams)
    at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
    return np.where(heads[at] == own, counts[at], 0)


def ordered(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the global order, as ascending keys: frequent n-grams carry the top bit."""
    return np.sort(np.where(_times(grams, frequent) > 0, grams | _TOP, grams))


def least_overlap(size: int, percent: int) -> int:
    """Overlap that a set of this size needs with any set it links to."""
    return -(-percent * size // 100)


def shared_least(size: int, percent: int) -> int:
    """First n-grams that a set of this size shares with any different set it links to.

    The overlap of two different, linked sets is at least ``percent / (100 - percent)``.
    """
    most = size if percent >= 100 else percent // (100 - percent)
    return max(1, min(most, 3), min(SHARED * size // 100, least_overlap(size, percent)))


def _shared(size: Column, percent: int) -> Column:
    """``shared_least`` as an expression."""
    least = F.ceil(F.lit(percent) * size / 100)
    most = size if percent >= 100 else F.lit(percent // (100 - percent))
    share = F.least(F.floor(F.lit(SHARED) * size / 100), least)
    return F.greatest(F.lit(1), F.least(most, F.lit(3)), share)


def _prefix(size: int, percent: int) -> int:
    return min(size, size - least_overlap(size, percent) + shared_least(size, percent))


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    spread = W.mixed(grams + np.uint64(len(grams)))
    return int(spread.sum() >> _HALF), int(W.mixed(spread ^ _TOP).sum() >> _HALF)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of documents (``id``, ``size``, ``d1``, ``d2``) and of counted n-grams.

    A task deals its n-grams, by their first 32 bits, to ``BUCKETS`` ranges as packed arrays:
    ``heads`` and ``counts``.
    """
    names = ["id", "size", "d1", "d2", "bucket", "heads", "counts"]
    kinds = [pa.int64()] * 5 + [pa.binary()] * 2

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        heads, counts = np.unique(np.concatenate(parts), return_counts=True)
        edges = np.arange(BUCKETS + 1, dtype=np.uint64) * np.uint64((1 << 32) // BUCKETS)
        cuts = np.searchsorted(heads.astype(np.uint64), edges)
        counts = counts.astype("<i4")
        rows = [(b, a, z) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
        nothing = [pa.nulls(len(rows), pa.int64())] * 4
        return pa.RecordBatch.from_arrays(
            [
                *nothing,
                pa.array([b for b, _, _ in rows], pa.int64()),
                pa.array([heads[a:z].tobytes() for _, a, z in rows], pa.binary()),
                pa.array([counts[a:z].tobytes() for _, a, z in rows], pa.binary()),
            ],
            names,
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            rows = np.zeros((len(batch), 3), dtype=np.int64)
            for i, grams in grams_of(batch["text"], width):
                rows[i] = len(grams), *_digest(grams)
                parts.append(_head(grams))
                held += len(grams)
                if held > HELD:
                    yield packed(parts)
                    parts, held = [], 0
            columns = [batch["id"], *[pa.array(rows[:, k]) for k in range(3)]]
            empty = [pa.nulls(len(batch), k) for k in kinds[4:]]
            yield pa.RecordBatch.from_arrays(columns + empty, names)
        if held:
            yield packed(parts)

    return _narrow(docs).mapInArrow(
        task,
        "id long, size long, d1 long, d2 long, bucket long, heads binary, counts binary",
    )


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Heads of the most frequent n-grams, sorted, and their counts; bounded on the driver."""

    def count(table: pa.Table) -> pa.Table:
        heads = np.concatenate([np.frombuffer(x, "<u4") for x in table["heads"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<i4") for x in table["counts"].to_pylist()])
        kinds, at = np.unique(heads, return_inverse=True)
        n = np.bincount(at, weights=counts).astype(np.int64)
        many = n > FREQUENT
        return pa.table({"head": pa.array(kinds[many].astype("i8")), "n": pa.array(n[many])})

    counted = (
        described.where("bucket is not null")
        .select("bucket", "heads", "counts")
        .groupBy("bucket")
        .applyInArrow(count, "head long, n long")
    )
    most = counted.orderBy(F.desc("n"), "head").limit(FREQUENT_MOST).toArrow()
    heads = most["head"].to_numpy().astype(np.uint32)
    by = np.argsort(heads)
    return heads[by], most["n"].to_numpy()[by]


def prefixes(docs: DataFrame, frequent, width: int, percent: int, buckets: int) -> DataFrame:
    """First n-grams that two classes or more hold: ``gram``, ``d1``, ``d2`` (16 bits of it)."""

    def dealt(held: dict) -> pa.RecordBatch:
        """Held classes as one row a bucket: n-grams and digests of their classes."""
        grams = np.concatenate(list(held.values()))
        sizes = [len(g) for g in held.values()]
        keys = np.repeat(np.array(list(held), dtype=np.int64), sizes, axis=0)
        parts = _times(grams, frequent.value) // TOGETHER + 1
        place = (keys[:, 0] % parts).astype(np.uint64)
        bucket = (W.mixed(grams + place) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        grams, keys, bucket = grams[by], keys[by], bucket[by]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cuts = list(zip(starts, [*starts[1:], len(bucket)], strict=True))
        short = (keys[:, 1] & 0x7FFF).astype("<i2")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[starts]),
                pa.array([grams[a:z].tobytes() for a, z in cuts], pa.binary()),
                pa.array([keys[a:z, 0].tobytes() for a, z in cuts], pa.binary()),
                pa.array([short[a:z].tobytes() for a, z in cuts], pa.binary()),
            ],
            ["bucket", "grams", "d1", "d2"],
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for batch in batches:
            for _, grams in grams_of(batch["text"], width):
                if len(grams) and (key := _digest(grams)) not in held:
                    first = ordered(grams, frequent.value)[: _prefix(len(grams), percent)]
                    held[key] = first.copy()
                    n += len(first)
                    if n > HELD:
                        yield dealt(held)
                        held, n = {}, 0
        if held:
            yield dealt(held)

    def meet(table: pa.Table) -> pa.Table:
        kinds = {"grams": "<u8", "d1": "<i8", "d2": "<i2"}
        grams, d1, d2 = (
            np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()])
            for c, t in kinds.items()
        )
        by = np.lexsort((d2, d1, grams))
        grams, d1, d2 = grams[by], d1[by], d2[by]
        same = grams[1:] == grams[:-1]
        copy = same & (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])  # a class that several tasks hold
        keep = np.concatenate([[True], ~copy])
        grams, d1, d2 = grams[keep], d1[keep], d2[keep]
        same = np.concatenate([[False], grams[1:] == grams[:-1], [False]])
        shared = same[:-1] | same[1:]
        # classes of a very frequent n-gram may lie in other buckets
        shared |= _times(grams, frequent.value) >= TOGETHER
        return pa.table(
            {
                "gram": pa.array(grams[shared].view("i8")),
                "d1": pa.array(d1[shared]),
                "d2": pa.array(d2[shared]),
            }
        )

    packed = _narrow(docs).mapInArrow(deal, "bucket long, grams binary, d1 binary, d2 binary")
    return packed.groupBy("bucket").applyInArrow(meet, "gram long, d1 long, d2 short")


def probe(texts: DataFrame, pairs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """Links between sets of the two sides of each key: ``a``, ``b``.

    ``pairs`` holds ``key``, ``id`` and ``tree`` (whether the id's set goes into the key's tree or
    is walked through it). Both sides are cut into blocks of bounded size, each tree block meeting
    each block of walkers once. ``texts`` holds ``id`` and ``text``.
    """
    # both sides' blocks from one aggregate, so that the pairs are read twice, whatever leads to them
    blocks = pairs.groupBy("key").agg(
        F.ceil(F.count_if("tree") / TREE).cast("long").alias("trees"),
        F.ceil(F.count_if(~F.col("tree")) / PROBES).cast("long").alias("walkers"),
    )
    dealt = pairs.join(blocks.where("trees > 0 and walkers > 0"), "key")
    own = F.when(F.col("tree"), F.col("trees")).otherwise(F.col("walkers"))
    others = F.when(F.col("tree"), F.col("walkers")).otherwise(F.col("trees"))
    dealt = dealt.select(
        "key",
        "id",
        "tree",
        F.pmod(F.xxhash64("id"), own).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"),
    )
    cells = dealt.select(
        "key",
        "id",
        F.when(F.col("tree"), F.col("block")).otherwise(F.col("other")).alias("t"),
        F.when(F.col("tree"), F.col("other")).otherwise(F.col("block")).alias("w"),
        "tree",
    )

    def walk(table: pa.Table) -> pa.Table:
        ids, tree = table["id"].to_numpy(), table["tree"].to_numpy(zero_copy_only=False)
        sets: list[np.ndarray] = [None] * len(ids)
        for i, grams in grams_of(table["text"].combine_chunks(), width):
            sets[i] = ordered(grams, frequent.value)
        links = set()
        stored = [i for i in np.flatnonzero(tree) if len(sets[i])]
        root = PrefixTree([sets[i] for i in stored], percent)
        for i in np.flatnonzero(~tree):
            for j in root.matches(sets[i]):
                a, b = int(ids[i]), int(ids[stored[j]])
                if a != b:
                    links.add((min(a, b), max(a, b)))
        found = np.array(sorted(links), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    joined = cells.join(texts, "id")
    return (
        joined.select("key", "t", "w", "id", "tree", "text")
        .groupBy("key", "t", "w")
        .applyInArrow(walk, "a long, b long")
    )


def _starred(known: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs for ``probe``: leaders of the n-grams' groups walk through members of other components.

    ``known`` holds ``gram``, ``id``, ``size`` and ``comp``. A leader of a group has the smallest of
    some hash of the id, so near copies meet the same few leaders in most of their groups.
    """
    hashes = [F.xxhash64("id", F.lit(seed * LEADERS + k)) for k in range(LEADERS)]
    leads = known.groupBy("gram").agg(
        F.count("*").alias("n"),
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
        *[F.min_by(c, h).alias(f"{c}{k}") for k, h in enumerate(hashes) for c in ("id", "size", "comp")],
    )
    each = [F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("id", "size", "comp")]) for k in range(LEADERS)]
    leads = leads.where("low < high").withColumn(
        "leads",
        F.when(F.col("n") > FREQUENT, F.array_distinct(F.array(*each))).otherwise(F.array(each[0])),
    )
    pairs = known.join(leads.select("gram", F.explode("leads").alias("lead")), "gram")
    pairs = pairs.where("comp <> lead.comp").select(
        "id", "size", F.col("lead.id").alias("key"), F.col("lead.size").alias("lead_size")
    )
    need = F.least(_shared(F.col("size"), percent), _shared(F.col("lead_size"), percent))
    near = pairs.groupBy("key", "lead_size", "id", "size").count().where(F.col("count") >= need)
    members = store(near.select("key", "id", F.lit(True).alias("tree")), "jaccard-starred")
    leaders = members.select("key", F.col("key").alias("id"), F.lit(False).alias("tree")).distinct()
    return members.unionByName(leaders)


def _known(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """``recs`` with each class's component, but for n-grams that only one component holds."""
    placed = recs.join(labels, F.col("id") == F.col("node"), "left")
    placed = placed.select("gram", "id", "size", F.coalesce("label", "id").alias("comp"))
    open_ = placed.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return placed.join(open_.where("low < high").select("gram"), "gram")


def _rests(texts: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """Every n-gram that may be the first one a class shares with a linked one, and what comes from there on.

    ``id``, ``size``, ``gram``, ``rest``: elements of the ordered set from the n-gram to the end.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for i, grams in grams_of(batch["text"], width):
                n = len(grams)
                first = ordered(grams, frequent.value)[: n - least_overlap(n, percent) + 1]
                columns = [np.full(len(first), ids[i]), np.full(len(first), n), first.view("i8"), n - np.arange(len(first))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "size", "gram", "rest"])

    return texts.mapInArrow(task, "id long, size long, gram long, rest long")


def _cells(rests: DataFrame, percent: int) -> DataFrame:
    """Cells in which classes of one n-gram can link: ``gram``, ``small``, ``large``, ``id``, ``comp``, ``is_large``.

    Two sets link from an n-gram on only if both rests reach the overlap that their sizes ask for, so a
    class goes to the cells of its own band and of every band with a size that its rest allows. Cells
    without two components on their sides are left out.
    """
    p, ratio = percent, 1 + BAND / 100
    # the other size b has percent * (a + b) <= (100 + percent) * rest, and is no further than the share
    reach = F.expr(f"(100 + {p}) * rest div {max(p, 1)} - size")
    least, most = F.ceil(F.lit(p) * F.col("size") / 100), F.expr(f"100 * size div {max(p, 1)}")

    def band(c: Column) -> Column:
        return F.floor(F.log(c.cast("double")) / F.log(F.lit(ratio)))

    own = rests.withColumn("own", band(F.col("size")))
    # one band more on both sides, for logarithms are rounded
    low, high = band(F.greatest(least, F.lit(1))) - 1, band(F.least(most, reach)) + 1
    # only bands that a class of another component is in
    ends = [F.min("comp").alias("c0"), F.max("comp").alias("c1")]
    bands = own.groupBy("gram", F.col("own").alias("other")).agg(*ends)
    able = own.where(F.least(most, reach) >= least).withColumns({"low": low, "high": high}).join(bands, "gram")
    able = able.where("other between low and high and (c0 <> comp or c1 <> comp)")
    cells = able.select(
        "gram", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large"),
        "id", "comp", (F.col("own") >= F.col("other")).alias("is_large"), (F.col("own") <= F.col("other")).alias("is_small"),
    )
    cell = ["gram", "small", "large"]
    sides = [F.when(F.col(f"is_{s}"), F.col("comp")) for s in ("large", "small")]
    open_ = cells.groupBy(*cell).agg(
        F.min(sides[0]).alias("l0"), F.max(sides[0]).alias("l1"), F.min(sides[1]).alias("s0"), F.max(sides[1]).alias("s1")
    )
    open_ = open_.where("l0 is not null and s0 is not null and least(l0, s0) < greatest(l1, s1)")
    return cells.join(open_.select(*cell), cell)


def _crowds(texts: DataFrame, known: DataFrame, crowded: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """Pairs for ``probe``: classes that share a crowded n-gram and whose sizes allow a link.

    Classes that n-grams of the same cell connect are probed together, a cell at a time, once.
    """
    held = known.join(crowded, "gram").select("id", "comp").distinct()
    rests = _rests(texts.join(held, "id", "left_semi"), frequent, width, percent)
    rests = store(rests.join(crowded, "gram", "left_semi").join(held, "id"), "jaccard-rests")
    cells = store(_cells(rests, percent), "jaccard-cells")
    cell = ["gram", "small", "large"]
    ends = cells.groupBy(*cell).agg(F.min("id").alias("b")).join(cells.select(*cell, "id"), cell)
    labels = connected(ends.select(F.col("id").alias("a"), "b"))
    placed = cells.join(labels, F.col("id") == F.col("node"), "left")
    # negative keys are apart from the ids that other probes have as keys
    key = -1 - F.pmod(F.xxhash64(F.coalesce("label", "id"), "small", "large"), F.lit(2**62))
    placed = store(placed.select(key.alias("key"), "id", "comp", "is_large", "is_small").distinct(), "jaccard-crowds")
    counts = placed.groupBy("key", "comp").count().groupBy("key")
    largest = counts.agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"))
    sides = placed.join(largest, "key").withColumn("main", F.col("comp") == F.col("largest"))
    # links within the largest component need no proof: it walks through no tree of its own
    other_key = (F.col("key") - F.lit(2**62)).alias("key")
    parts = [
        ("is_large", "key", True), ("is_small and not main", "key", False),
        ("is_small and not is_large and main", other_key, True), ("is_large and not is_small and not main", other_key, False),
    ]
    first, *rest = [sides.where(w).select(k, "id", F.lit(tree).alias("tree")) for w, k, tree in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def _remaining(
    texts: DataFrame, known: DataFrame, nodes: DataFrame, frequent, width: int, percent: int
) -> DataFrame:
    """Pairs for ``probe``: components that share first n-grams, the larger one as the tree."""
    sizes = nodes.groupBy("comp").agg(
        F.count("*").alias("n"), F.min(_shared(F.col("size"), percent)).alias("need")
    )
    groups = store(known.select("gram", "comp").distinct(), "jaccard-groups")
    many = F.count("*") > PAIRED
    crowded = store(groups.groupBy("gram").agg(many.alias("many")).where("many").select("gram"), "crowded")
    groups = groups.join(crowded, "gram", "left_anti").join(sizes, "comp")
    other = groups.select("gram", *[F.col(c).alias(f"{c}_") for c in ("comp", "n", "need")])
    sides = ["comp", "n", "comp_", "n_"]
    meeting = groups.join(other, "gram").where("comp < comp_").groupBy(*sides, "need", "need_").count()
    swap = F.col("n") < F.col("n_")
    sized = store(
        meeting.where("count >= least(need, need_)").select(
            F.when(swap, F.col("comp_")).otherwise(F.col("comp")).alias("key"),
            F.when(swap, F.col("comp")).otherwise(F.col("comp_")).alias("comp"),
        ),
        "jaccard-meeting",
    )
    keys = sized.select("key", F.col("key").alias("comp"), F.lit(True).alias("tree")).distinct()
    walkers = sized.select("key", "comp", F.lit(False).alias("tree"))
    pairs = keys.unionByName(walkers).join(nodes, "comp").select("key", "id", "tree")
    if not crowded.take(1):
        return pairs
    return pairs.unionByName(_crowds(texts, known, crowded, frequent, width, percent))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their n-gram sets; the
    component is the smallest ``doc_id`` that links lead to, the document's own included.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        described = store(describe(docs, width, percent), "jaccard-described")
    rows = described.where("bucket is null").select("id", "size", "d1", "d2")
    frequent = spark.sparkContext.broadcast(_frequent(described))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(BUCKETS, int(total) * (100 - percent + SHARED) // 100 // BUCKET)
    classes = rows.where("size > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("id"), F.min("size").alias("size")
    )
    short = classes.select("d1", F.col("d2").bitwiseAND(0x7FFF).cast("short").alias("d2"), "id", "size")
    recs = prefixes(docs, frequent, width, percent, buckets).join(short, ["d1", "d2"])
    # a class needs enough shared n-grams to be linked at all
    with arrow_rows(spark, BATCH_ROWS):
        recs = store(recs.select("gram", "id", "size"), "jaccard-prefixes")
    active = recs.groupBy("id", "size").count().where(F.col("count") >= _shared(F.col("size"), percent))
    active = store(active.select("id", "size"), "jaccard-active")
    recs = store(recs.join(active.select("id"), "id", "left_semi"), "jaccard-recs")
    texts = store(_narrow(docs).join(active, "id", "left_semi"), "jaccard-texts")

    labels = spark.createDataFrame([], "node long, label long")
    known = recs.withColumn("comp", F.col("id"))
    for seed in range(ROUNDS):
        links = probe(texts, _starred(known, seed, percent), frequent, width, percent)
        stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = connected(stars.unionByName(links))
        known = store(_known(recs, labels), "jaccard-known")
        if not known.groupBy("gram").count().where(f"count > {FREQUENT}").take(1):
            break
    nodes = active.join(labels, F.col("id") == F.col("node"), "left")
    nodes = store(nodes.select("id", "size", F.coalesce("label", "id").alias("comp")), "jaccard-nodes")
    # stored, since a probe reads its pairs several times and would plan all that leads to them each time
    pairs = store(_remaining(texts, known, nodes, frequent, width, percent), "jaccard-pairs")
    more = probe(texts, pairs, frequent, width, percent)

    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    reps = classes.select("d1", "d2", F.col("id").alias("rep"))
    same = rows.join(several, "id").join(reps, ["d1", "d2"]).where("rep <> id")
    same = same.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = connected(stars.unionByName(more).unionByName(same))

    placed = reps.join(labels, F.col("rep") == F.col("node"), "left").select(
        "d1", "d2", F.coalesce("label", "rep").alias("comp")
    )
    null = F.lit(LAST)
    return rows.join(placed, ["d1", "d2"], "left").select(
        F.nullif("id", null).alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.nullif(F.coalesce("comp", "id"), null).alias("component_id"),
    )


ship_by_value(__name__)
