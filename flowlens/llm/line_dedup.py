"""Line dedup by probing a sharded minimal perfect hash of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower case, hashed to 128
bits. Distinct keys are counted, dealt to shards by hash, and each shard becomes one row that holds
a minimal perfect hash with fingerprint, count and first-holder arrays. Documents send only their
line hashes to the shards; lines themselves are never joined. The few keys that would make a shard
hot form one more index of at most ``HOT_MOST`` keys that every task probes on the spot.

Defined results: a null or empty text is one empty line and becomes the empty text; rows that share a ``doc_id``
are one document; null ids together are one document that comes after all others; an empty table
gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.columns import free
from flowlens.llm.minimal_hash import LineIndex
from flowlens.session import ship_by_value, store

MIN_CHARS = 10
#: keys of a shard; a shard's arrays take about 30 bytes a key
SHARD_KEYS = 1 << 18
#: shards at the least, so that a small table still uses many tasks
SHARDS_LEAST = 128
#: keys in the index that every task holds (40 MB at most)
HOT_MOST = 1 << 20

LAST = 2**63 - 1  # stands for a null id
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_KEYS = "id long, low long, high long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a lower-cased line's key, or None if the key has fewer than ``min_chars`` characters."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or (
        len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars
    ):
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document row and distinct line key: ``id``, ``low``, ``high``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for id_, text in zip(batch["id"].to_pylist(), _texts(batch["text"]), strict=True):
                found = {line_key(x, min_chars) for x in text.translate(_LOWER).split(b"\n")}
                found.discard(None)
                ids += [id_] * len(found)
                digests += found
            low, high = _halves(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(low), pa.array(high)], ["id", "low", "high"]
            )

    return _narrow(docs).mapInArrow(keys, _KEYS)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")


def build_index(keys: DataFrame, shards: int, hot_rows: int) -> DataFrame:
    """One row a shard: ``shard``, ``arrays`` and the keys with more than ``hot_rows`` rows.

    A key that only one document holds counts 1, however often rows repeat that document.
    """
    counted = keys.groupBy("low", "high").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")
    )
    counted = counted.select(
        F.pmod("low", F.lit(shards)).alias("shard"),
        "low",
        "high",
        F.col("n").alias("rows"),
        F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("n")).alias("n"),
        "first",
    )

    def build(table: pa.Table) -> pa.Table:
        low, high = (table[c].to_numpy().view("u8") for c in ("low", "high"))
        counts, firsts = table["n"].to_numpy(), table["first"].to_numpy()
        hot = table["rows"].to_numpy() > hot_rows
        packed = np.stack([low[hot].view("i8"), high[hot].view("i8"), counts[hot], firsts[hot]])
        return pa.table(
            {
                "shard": table["shard"][:1],
                "arrays": pa.array([LineIndex.of(low, high, counts, firsts).dump()], pa.binary()),
                "hot": pa.array([packed.T.astype("<i8").tobytes()], pa.binary()),
            }
        )

    return counted.groupBy("shard").applyInArrow(build, "shard long, arrays binary, hot binary")


def _hot_index(index: DataFrame) -> LineIndex:
    """The keys with the most rows as an index of bounded size, for every task.

    Rows come one at a time, and a list that has twice the bound is cut to the largest counts, so
    the driver holds a bounded number of keys. Keys cut here are answered by their shard.
    """
    kept = np.zeros((0, 4), dtype="<i8")
    for row in index.where("length(hot) > 0").select("hot").toLocalIterator():
        kept = np.concatenate([kept, np.frombuffer(row["hot"], dtype="<i8").reshape(-1, 4)])
        if len(kept) > 2 * HOT_MOST:
            kept = kept[np.argsort(-kept[:, 2], kind="stable")[:HOT_MOST]]
    kept = kept[np.argsort(-kept[:, 2], kind="stable")[:HOT_MOST]]
    low, high = (np.ascontiguousarray(kept[:, i]).view("u8") for i in (0, 1))
    return LineIndex.of(low, high, kept[:, 2], kept[:, 3])


def probe(keys: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The rows of ``keys`` to drop: other documents hold the line, one of them a smaller id."""
    hot = keys.sparkSession.sparkContext.broadcast(_hot_index(index).dump())

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LineIndex.load(hot.value)
        for batch in batches:
            ids = batch["id"].to_numpy()
            low, high = (batch[c].to_numpy().view("u8") for c in ("low", "high"))
            known, counts, firsts = local.probe(low, high)
            drop = known & (counts > 1) & (firsts != ids)
            out = pa.RecordBatch.from_arrays(
                [batch["id"], batch["low"], batch["high"], pa.array(known)], [*batch.schema.names, "known"]
            )
            yield out.filter(pa.array(drop | ~known))

    def in_shard(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        asked = asked.select(["id", "low", "high"])
        if not len(asked):
            return asked
        local = LineIndex.load(arrays["arrays"][0].as_py())
        low, high = (asked[c].to_numpy().view("u8") for c in ("low", "high"))
        known, counts, firsts = local.probe(low, high)
        return asked.filter(pa.array(known & (counts > 1) & (firsts != asked["id"].to_numpy())))

    first = store(keys.mapInArrow(at_once, _KEYS + ", known boolean"), "line-probes")
    rest = first.where("not known").withColumn("shard", F.pmod("low", F.lit(shards)))
    arrays = index.select("shard", "arrays").groupBy("shard")
    cold = rest.groupBy("shard").cogroup(arrays).applyInArrow(in_shard, _KEYS)
    return first.where("known").select("id", "low", "high").unionByName(cold)


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the dropped lines out of ``text``, and ``n_lines`` before and ``n_dropped``.

    All other columns stay, but for those that have the names of the two counts.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    schema = schema.add("n_lines", "long").add("n_dropped", "long")
    name = free(docs, "drops")
    by_doc = drops.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias(name))
    body = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), body)
    joined = keyed.join(by_doc, "id", "left").select(name, "row.*")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            flat = batch.column(0).flatten()
            digests = np.stack([flat.field(i).to_numpy() for i in (0, 1)], axis=1)
            sizes = batch.column(0).value_lengths().fill_null(0).to_numpy()
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for i, text in enumerate(_texts(batch.column(1 + kept.index("text")))):
                own = text.split(b"\n")
                gone = {d.tobytes() for d in digests[cuts[i] : cuts[i + 1]]}
                stay = own
                if gone:
                    low = text.translate(_LOWER).split(b"\n")
                    pairs = zip(own, low, strict=True)
                    stay = [a for a, b in pairs if line_key(b, min_chars) not in gone]
                texts.append(b"\n".join(stay))
                counts.append(len(own))
                dropped.append(len(own) - len(stay))
            out = list(batch.columns[1:])
            out[kept.index("text")] = pa.array(texts, pa.binary()).cast(pa.string())
            out += [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*kept, "n_lines", "n_dropped"])

    return joined.mapInArrow(lines, schema)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """Drop every line that an earlier document holds too.

    Lines whose key has at least ``min_chars`` characters and is found in two or more documents
    stay only in the document with the smallest ``doc_id``. Result: one row for each row of
    ``docs`` with all its columns, ``text`` being the lines kept, and ``n_lines``, ``n_dropped``.
    """
    keys = store(line_keys(docs, min_chars), "line-keys")
    rows = keys.count()  # from the files' footers
    shards = max(SHARDS_LEAST, -(-rows // shard_keys))
    index = store(build_index(keys, shards, max(1, rows // shards // 4)), "line-index")
    return drop_lines(docs, probe(keys, index, shards), min_chars)


ship_by_value(__name__)
