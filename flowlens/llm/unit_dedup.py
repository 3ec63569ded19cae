"""Substring dedup by hashing lines, cut at sentence ends where a line has several.

A unit is a line, or a part of one that ends in ``.``, ``!`` or ``?`` before white space; a part of more than
``LONGEST`` words is cut further after words that a hash picks, one in ``EVERY``, so that a passage in the middle
of different sentences is cut alike. With ``unit="line"`` or ``"paragraph"`` (text between empty lines) a unit
is that whole. Units are normalised (A-Z in lower case, runs of white space as one space), hashed to 128
bits and grouped over all documents. The earliest occurrence, by ``doc_id`` and place, stays; the others
are repeats.

What counts as a repeated passage is a definition, not a bound on work: a run of neighbouring repeats is
cut out, as one span, when those of its units that have ``min_chars`` characters or more have ``min_run``
together. Shorter units that many texts hold by chance (``the.``) stay unless such a run holds them. Spans
count the characters of the original text.

Defined results: null and empty texts have no units and become the empty text; rows that share a
``doc_id`` are one document; null ids together are one document after all others; an empty table
gives an empty result. All columns of the documents pass through, but for those that have the names
of the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.columns import free
from flowlens.session import ship_by_value, store

#: characters of a unit that counts, and of all such units of a run
MIN_CHARS, MIN_RUN = 30, 100
#: words of a sentence that is not cut further; one word in so many ends a part of a longer one
LONGEST, EVERY = 24, 6

LAST = 2**63 - 1  # stands for a null id
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_UNITS = {
    "sentence": re.compile(rb"[^\n]*?[.!?](?=[ \t\r\n]|\Z)|[^\n]+"),
    "line": re.compile(rb"[^\n]+"),
    "paragraph": re.compile(rb"[^\n]+(?:\n[^\n]+)*"),
}
_RESULT = "n_units long, n_removed long, spans array<struct<start:int,end:int>>"


_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def units(text: bytes, unit: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Byte range and normalised words of every unit with a word."""
    for found in _UNITS[unit].finditer(text.translate(_LOWER)):
        words = found[0].split()
        if unit == "sentence" and len(words) > LONGEST:
            first, start = 0, found.start()
            for k, word in enumerate(_WORD.finditer(found[0]), 1):
                if k == len(words) or xxhash.xxh3_64_intdigest(word[0]) % EVERY == 0:
                    end = found.end() if k == len(words) else found.start() + word.end()
                    yield start, end, words[first:k]
                    first, start = k, end
        elif words:
            yield found.start(), found.end(), words


def size(words: list[bytes]) -> int:
    """Characters of a normalised unit."""
    return len(b" ".join(words).decode("utf-8", "replace"))


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _digests(docs: DataFrame, unit: str) -> DataFrame:
    """One row for each document row and distinct unit: ``id``, ``low``, ``high``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for id_, text in zip(batch["id"].to_pylist(), _texts(batch["text"]), strict=True):
                found = {digest(words) for _, _, words in units(text, unit)}
                ids += [id_] * len(found)
                digests += found
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["id", "low", "high"],
            )

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")
    return narrow.mapInArrow(task, "id long, low long, high long")


def repeats(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """``id``, ``low``, ``high`` of every unit that an earlier document holds too."""
    every = store(_digests(docs, unit), "unit-digests")
    shared = every.groupBy("low", "high").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # one row a digest on this side, so a digest that many documents hold can be split
    later = every.join(shared.where("first <> last"), ["low", "high"])
    return later.where("id <> first").select("id", "low", "high")


def again(found: list[tuple[int, int, list[bytes]]], elsewhere: set[bytes]) -> set[int]:
    """Numbers of the units that an earlier document holds, or the text itself before."""
    out, seen = set(), set(elsewhere)
    for k, (_, _, words) in enumerate(found):
        own = digest(words)
        if own in seen:
            out.add(k)
        seen.add(own)
    return out


def runs(
    found: list[tuple[int, int, list[bytes]]], repeated: set[int], min_chars: int, min_run: int
) -> list[tuple[int, int]]:
    """Ranges of unit numbers of neighbouring repeats that are a passage together."""
    out, start, chars = [], None, 0
    for k in range(len(found) + 1):
        if k in repeated:
            start = k if start is None else start
            own = size(found[k][2])
            chars += own if own >= min_chars else 0
        elif start is not None:
            if chars >= max(min_run, 1):
                out.append((start, k))
            start, chars = None, 0
    return out


def cut(
    text: bytes, elsewhere: set[bytes], unit: str, min_chars: int, min_run: int
) -> tuple[bytes, int, int, list[dict]]:
    """Text without the repeats, its units, those removed, and their character spans."""
    found = list(units(text, unit))
    spans, kept, at, chars, removed = [], [], 0, 0, 0
    for a, b in runs(found, again(found, elsewhere), min_chars, min_run):
        start, end = found[a][0], found[b - 1][1]
        chars += len(text[at:start].decode("utf-8", "replace"))
        length = len(text[start:end].decode("utf-8", "replace"))
        spans.append({"start": chars, "end": chars + length})
        kept.append(text[at:start])
        at, chars, removed = end, chars + length, removed + b - a
    kept.append(text[at:])
    return b"".join(kept), len(found), removed, spans


def dedup_units(
    docs: DataFrame, unit: str = "sentence", min_chars: int = MIN_CHARS, min_run: int = MIN_RUN
) -> DataFrame:
    """``docs`` with repeats cut out of ``text``, and ``n_units``, ``n_removed``, ``spans``."""
    added = T.StructType.fromDDL(_RESULT)
    kept = [c for c in docs.columns if c.lower() not in added.names]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    name = free(docs, "again")
    by_doc = repeats(docs, unit).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias(name))
    body = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), body)
    joined = keyed.join(by_doc, "id", "left").select(name, "row.*")
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("text")
        for batch in batches:
            flat = batch.column(0).flatten()
            halves = np.stack([flat.field(i).to_numpy() for i in (0, 1)], axis=1)
            ends = np.cumsum(batch.column(0).value_lengths().fill_null(0).to_numpy())
            lists = [{x.tobytes() for x in own} for own in np.split(halves, ends[:-1])] if len(ends) else []
            rows = [
                cut(text, own, unit, min_chars, min_run)
                for text, own in zip(_texts(batch.column(1 + at)), lists, strict=True)
            ]
            texts, *found = list(zip(*rows, strict=True)) or [(), (), (), ()]
            out = list(batch.columns[1:])
            out[at] = pa.array(texts, pa.binary()).cast(pa.string())
            out += [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(out, [*kept, *added.names])

    return joined.mapInArrow(task, T.StructType([*schema, *added]))


ship_by_value(__name__)
