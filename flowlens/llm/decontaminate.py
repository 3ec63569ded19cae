"""Benchmark decontamination by backward search in one FM-index per shard of training text.

Phrases are windows of ``width`` consecutive words of a benchmark item, or the whole item if it has
fewer. Each task lays its documents out in shards of bounded size, builds an FM-index over a
shard's words, searches all phrases at once and locates their occurrences; the word ranges of a
document are merged into removal spans. Documents are never shuffled.

Words are compared by 64-bit hashes, so a phrase of 13 words matches wrongly with a chance below
2**-60. Defined results: null and empty texts have no words; null items are ignored; repeated items
and rows are answered each; an empty table gives an empty result. The documents' columns come back
in a struct, so none of them can clash with the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import words as W
from flowlens.llm.fm_index import FMIndex
from flowlens.session import ship_by_value, store

WINDOW = 13
#: text of one index; about ten times as much memory while it is built
SHARD_BYTES = 3 << 20
#: words of a piece of a long document
PIECE_WORDS = 1 << 19
#: benchmark text that every task holds at once; more items are searched block by block
PHRASE_BYTES = 16 << 20

_SPANS = "array<struct<start:int,end:int>>"
_LAST = f"n_words long, n_hit long, spans {_SPANS}"
_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Phrases(NamedTuple):
    """Distinct windows as a matrix of word hashes, and the items that hold each of them."""

    windows: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray  # window i belongs to items[bounds[i]:bounds[i + 1]]
    items: np.ndarray


def _windows(hashes: np.ndarray, width: int) -> list[bytes]:
    """The distinct windows of an item's word hashes."""
    if not len(hashes):
        return []
    return list({hashes[at : at + width].tobytes(): None for at in range(max(1, len(hashes) - width + 1))})


def _phrases(holders: dict[bytes, list[str]], width: int) -> Phrases:
    """Windows with the items that hold them."""
    windows = np.zeros((len(holders), width), dtype=np.uint64)
    sizes = np.array([len(k) // 8 for k in holders], dtype=np.int64)
    for i, k in enumerate(holders):
        windows[i, : sizes[i]] = np.frombuffer(k, dtype=np.uint64)
    counts = [len(v) for v in holders.values()]
    items = np.array([x for v in holders.values() for x in sorted(v)], dtype=object)
    return Phrases(windows, sizes, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), items)


def phrases_of(item_ids: list[str], texts: list[str | None], width: int = WINDOW) -> Phrases:
    """The distinct windows of some items."""
    data, bounds = W.column_bytes(pa.array(texts, pa.string()))
    data = W.LOWER[data]
    words = W.split(data, bounds, W.ALNUM)
    hashes = W.hashes(data, words)
    holders: dict[bytes, set[str]] = {}
    for i, item in enumerate(item_ids):
        for window in _windows(hashes[words.bounds[i] : words.bounds[i + 1]], width):
            holders.setdefault(window, set()).add(item)
    return _phrases({k: list(v) for k, v in holders.items()}, width)


def phrase_blocks(benchmark: DataFrame, width: int, most: int) -> DataFrame:
    """The benchmark's distinct windows and their items, packed in rows of about ``most`` bytes.

    A window that many items hold may lie in several rows, each with some of the items.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body"))
    items = items.where("item is not null and body is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = W.column_bytes(batch["body"])
            for a, b in W.blocks(bounds, SHARD_BYTES):
                own = W.LOWER[data[bounds[a] : bounds[b]]]
                words = W.split(own, bounds[a : b + 1] - bounds[a], W.ALNUM)
                hashes = W.hashes(own, words)
                for i in range(b - a):
                    found = _windows(hashes[words.bounds[i] : words.bounds[i + 1]], width)
                    names = pa.array([batch["item"][a + i].as_py()] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), names], ["window", "item"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: dict[bytes, list[str]] = {}
        held = 0
        for batch in batches:
            for window, item in zip(batch["window"].to_pylist(), batch["item"].to_pylist(), strict=True):
                if held > most:
                    yield _packed(_phrases(holders, width))
                    holders, held = {}, 0
                held += len(item) + (0 if window in holders else 8 * width)
                holders.setdefault(window, []).append(item)
        if holders:
            yield _packed(_phrases(holders, width))

    windows = store(items.mapInArrow(cut, "window binary, item string").distinct(), "benchmark-windows")
    # dealt by as many keys as blocks are needed: rows follow the keys, however many partitions there are
    parts = max(1, windows.count() * 8 * width // most)
    dealt = windows.repartition(F.pmod(F.xxhash64("window"), F.lit(parts)))
    return dealt.sortWithinPartitions("window", "item").mapInArrow(pack, _BLOCK)


_BLOCK = "windows binary, sizes binary, bounds binary, items array<string>"


def _packed(phrases: Phrases) -> pa.RecordBatch:
    columns = [pa.array([x.tobytes()], pa.binary()) for x in phrases[:3]]
    items = pa.array([phrases.items.tolist()], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*columns, items], ["windows", "sizes", "bounds", "items"])


def _unpacked(row, width: int) -> Phrases:
    windows, sizes, bounds = (
        np.frombuffer(row[c], t) for c, t in (("windows", "<u8"), ("sizes", "<i8"), ("bounds", "<i8"))
    )
    return Phrases(windows.reshape(-1, width), sizes, bounds, np.array(row["items"], dtype=object))


def _pieces(bounds: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into pieces of at most ``most`` words that overlap: text, first and end word."""
    rows = []
    for text in range(len(bounds) - 1):
        at, end = int(bounds[text]), int(bounds[text + 1])
        while end - at > most:
            rows.append((text, at, at + most))
            at += most - overlap
        rows.append((text, at, end))
    out = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _shards(first: np.ndarray, end: np.ndarray, most: int) -> Iterator[slice]:
    total = np.concatenate([[0], np.cumsum(end - first)])
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield slice(at, stop)
        at = stop


def find_hits(data: np.ndarray, bounds: np.ndarray, phrases: Phrases, piece: int = PIECE_WORDS):
    """Words of the texts, the hit ranges as +1 and -1 steps, and (text, window) of the hits."""
    words = W.split(data, bounds, W.ALNUM)
    hashes = W.hashes(data, words)
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    width = phrases.windows.shape[1]
    piece = max(piece, 2 * width)
    text, first, end = _pieces(words.bounds, piece, width - 1)
    for shard in _shards(first, end, piece):
        sizes = end[shard] - first[shard]
        if not sizes.sum() or not len(phrases.sizes):
            continue
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.repeat(first[shard] - cuts[:-1], sizes) + np.arange(cuts[-1])
        index = FMIndex(hashes[taken], cuts)
        low, high = index.search(phrases.windows, phrases.sizes)
        found = high - low
        window = np.repeat(np.arange(len(found)), found)
        rows = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
        which, at = index.locate(rows)
        start = first[shard][which] + at
        np.add.at(step, start, 1)
        np.add.at(step, start + phrases.sizes[window], -1)
        pairs.append(np.stack([text[shard][which], window], axis=1))
    return words, step, np.unique(np.concatenate(pairs), axis=0)


def _text(batch: pa.RecordBatch) -> pa.Array:
    return pc.struct_field(batch["row"], "text")


def _runs(hit: np.ndarray) -> np.ndarray:
    """Ranges of consecutive true values."""
    edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.flatnonzero(edges).reshape(-1, 2)


def _characters(data: np.ndarray, edges: list[int], start: int) -> list[int]:
    """Characters between byte ``start`` and each of the ascending byte places ``edges``."""
    out, at, chars = [], start, 0
    for edge in edges:
        chars += int(((data[at:edge] & 0xC0) != 0x80).sum())
        out.append(chars)
        at = edge
    return out


def _search(docs: DataFrame, phrases: Phrases, last: bool) -> DataFrame:
    """Search one block of phrases in ``row.text`` and add its hits to those ``docs`` carries."""
    held = docs.sparkSession.sparkContext.broadcast(phrases)

    def texts(batch: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
        data, bounds = W.column_bytes(_text(batch).slice(a, b - a))
        data = W.LOWER[data]
        words, step, pairs = find_hits(data, bounds, held.value)
        items = [set(x) for x in batch["items"].slice(a, b - a).to_pylist()]
        for doc, window in pairs:
            own = slice(*held.value.bounds[window : window + 2])
            items[doc].update(held.value.items[own])
        for i, earlier in enumerate(batch["ranges"].slice(a, b - a).to_pylist()):
            for r in earlier:
                step[words.bounds[i] + r["start"]] += 1
                step[words.bounds[i] + r["end"]] -= 1
        hit = np.cumsum(step[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        n_hit = before[words.bounds[1:]] - before[words.bounds[:-1]]
        ranges, spans = [], []
        for i in range(b - a):
            first, end = words.bounds[i : i + 2]
            runs = _runs(hit[first:end]) if n_hit[i] else np.zeros((0, 2), np.int64)
            edges = [e for x, y in runs for e in (words.starts[first + x], words.ends[first + y - 1])]
            chars = _characters(data, edges, int(bounds[i]))
            ranges.append([{"start": int(x), "end": int(y)} for x, y in runs])
            spans.append(
                [{"start": x, "end": y} for x, y in zip(chars[::2], chars[1::2], strict=True)]
            )
        found = {"items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        if last:
            found |= {
                "n_words": pa.array(np.diff(words.bounds), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "spans": pa.array(spans, _RANGE),
            }
        else:
            found |= {"ranges": pa.array(ranges, _RANGE)}
        return pa.RecordBatch.from_pydict({"row": batch["row"].slice(a, b - a)} | found)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = W.column_bytes(_text(batch))
            for a, b in W.blocks(bounds, SHARD_BYTES):
                yield texts(batch, a, b)

    found = "items array<string>, " + (_LAST if last else f"ranges {_SPANS}")
    schema = T.StructType([docs.schema["row"], *T.StructType.fromDDL(found)])
    return docs.mapInArrow(task, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, phrase_bytes: int = PHRASE_BYTES
) -> DataFrame:
    """Benchmark occurrences in every document.

    Result, one row for each row of ``docs``: the struct ``row`` of all its columns, ``n_words``,
    ``n_hit`` (words inside an occurrence), ``items`` (ids of the items that occur, sorted as
    strings) and ``spans`` (merged character ranges to remove). Windows are cut, made distinct and packed by
    Spark; those of more than ``phrase_bytes`` are searched in blocks. Each pass over the texts then leaves
    the hits only, which meet their documents once, at the end.
    """
    blocks = store(phrase_blocks(benchmark, width, phrase_bytes), "benchmark-blocks")
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    several = blocks.count() > 1
    if several:
        # numbers that passes share are stored, for a scan may be dealt out otherwise another time
        carried = store(carried.withColumn("at", F.monotonically_increasing_id()), "decontaminate-rows")
    searched = carried.select(F.struct("at", "row.text").alias("row")) if several else carried
    searched = searched.withColumns(_nothing())
    hits, phrases = [], phrases_of([], [], width)
    for block in blocks.toLocalIterator():
        phrases = _unpacked(block, width)
        if several:
            found = _search(searched, phrases, last=False).where("size(items) > 0")
            hits.append(store(found.select("row.at", "items", "ranges"), "decontaminate-hits"))
    if not several:
        return _search(searched, phrases, last=True)
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    by_row = every.groupBy("at").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.flatten(F.collect_list("ranges")).alias("ranges"),
    )
    joined = carried.join(by_row, "at", "left").select(
        "row", *[F.coalesce(c, nothing).alias(c) for c, nothing in _nothing().items()]
    )
    return _search(joined, phrases_of([], [], width), last=True)


def _nothing() -> dict[str, Column]:
    return {
        "items": F.expr("cast(array() as array<string>)"),
        "ranges": F.expr(f"cast(array() as {_SPANS})"),
    }


def contaminated() -> Column:
    """At least a twentieth of the document's words are benchmark words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


ship_by_value(__name__)
