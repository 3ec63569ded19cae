"""Sequence-number scan of ESP/AH security associations.

Per SA, in packet order, a running maximum ``m`` meets each sequence number ``q``: a fall of more
than 2^31 is a counter wrap and restarts the maximum; ``q > m`` raises it; anything else is an
anomaly. The step is a function of ``m``, so a run of packets is one too, and those functions
compose: packets are scanned in (SA, chunk) blocks, the block functions are chained per SA, and
the blocks are scanned again from their true entry value. No task holds a whole SA.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.keys import CHUNK_ROWS, chunk_of
from flowlens.session import ship_by_value

# ---- fixed values ------------------------------------------------------------------------
SEQUENCE_WRAP = 1 << 31
SHOWN_ANOMALIES = 5

SA = ["capture_id", "source_table", "spi", "direction"]
ship_by_value(__name__)
_BEFORE_FIRST = -1  # entry value of a block that starts its SA
_TOP = 1 << 62
_WINDOW = 64


def transfer_function(sequence: np.ndarray) -> tuple[list[int], list[int]]:
    """Entry maximum -> exit maximum over a block, as upper bounds and values of its pieces.

    A value of -1 stands for "unchanged". Entry values are -1 (nothing seen) and upwards.
    """
    low_end, high_start = _BEFORE_FIRST, _TOP  # entries in [low_end, high_start] are unchanged
    low: list[list[int]] = []  # [upper entry bound, current value], rising bounds
    high: list[list[int]] = []  # [lower entry bound, current value], falling bounds
    for q in sequence.tolist():
        for piece in low:
            if piece[1] < q or piece[1] > q + SEQUENCE_WRAP:
                piece[1] = q
        for piece in high:
            if piece[1] < q or piece[1] > q + SEQUENCE_WRAP:
                piece[1] = q
        if low_end < q and low_end <= high_start:
            low.append([min(q - 1, high_start), q])
            low_end = q
        if high_start > q + SEQUENCE_WRAP and low_end <= high_start:
            high.append([max(q + SEQUENCE_WRAP + 1, low_end), q])
            high_start = q + SEQUENCE_WRAP
        low = _merged(low)
        high = _merged(high)
    bounds = [piece[0] for piece in low]
    values = [piece[1] for piece in low]
    if low_end <= high_start:
        bounds.append(high_start)
        values.append(-1)
    upper = _TOP
    tail = []
    for piece in high:
        tail.append((upper, piece[1]))
        upper = piece[0] - 1
    for bound, value in reversed(tail):
        bounds.append(bound)
        values.append(value)
    return bounds, values


def _merged(pieces: list[list[int]]) -> list[list[int]]:
    """Neighbouring pieces with the same value become one."""
    if all(a[1] != b[1] for a, b in zip(pieces, pieces[1:], strict=False)):
        return pieces
    kept = [a for a, b in zip(pieces, pieces[1:], strict=False) if a[1] != b[1]]
    return [*kept, pieces[-1]]


def apply_transfer(bounds: list[int], values: list[int], entry: int) -> int:
    value = values[int(np.searchsorted(np.asarray(bounds), entry, side="left"))]
    return entry if value == -1 else int(value)


def scan_block(sequence: np.ndarray, entry: int) -> np.ndarray:
    """Anomaly mask of a block entered with maximum ``entry`` (-1 at the start of an SA).

    Runs between counter wraps are found in windows that grow while no wrap is met and start small
    after one, so the work stays in proportion to the block however many wraps it has.
    """
    flags = np.zeros(len(sequence), dtype=bool)
    start, width = 0, _WINDOW
    while start < len(sequence):
        rest = sequence[start : start + width]
        reached = np.maximum.accumulate(np.concatenate(([entry], rest)))
        wrapped = np.flatnonzero(reached[:-1] - rest > SEQUENCE_WRAP)
        end = int(wrapped[0]) if wrapped.size else len(rest)
        flags[start : start + end] = rest[:end] <= reached[:end]
        if wrapped.size:
            entry, width = int(rest[end]), _WINDOW
            start += end + 1
        else:
            entry, width = int(reached[-1]), 2 * width
            start += end
    return flags


_Block = dict[str, np.ndarray]


def _blocks(
    frames: Iterator[pd.DataFrame], keys: list[str], values: list[str]
) -> Iterator[tuple[tuple, _Block]]:
    """Whole key groups out of sorted batches; a group may span batches."""
    pending: list[_Block] = []
    current: tuple | None = None

    def joined() -> _Block:
        if len(pending) == 1:
            return pending[0]
        return {c: np.concatenate([block[c] for block in pending]) for c in values}

    for frame in frames:
        if frame.empty:
            continue
        columns = {c: frame[c].to_numpy() for c in keys}
        data = {c: frame[c].to_numpy() for c in values}
        changed = np.zeros(len(frame), dtype=bool)
        for column in columns.values():
            changed[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), len(frame)]
        for begin, end in zip(starts, starts[1:], strict=False):
            key = tuple(column[begin] for column in columns.values())
            if current is not None and key != current:
                yield current, joined()
                pending = []
            current = key
            pending.append({c: array[begin:end] for c, array in data.items()})
    if current is not None:
        yield current, joined()


_KEY_DDL = "capture_id string, source_table string, spi string, direction string"


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for key, block in _blocks(frames, [*SA, "chunk"], ["packet_id", "sequence_number"]):
        bounds, values = transfer_function(block["sequence_number"])
        rows.append((*key, int(block["packet_id"][0]), bounds, values))
        if len(rows) >= 2000:
            yield pd.DataFrame(rows, columns=[*SA, "chunk", "first_id", "bounds", "results"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=[*SA, "chunk", "first_id", "bounds", "results"])


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, reached, first_id = None, _BEFORE_FIRST, 0
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            key = tuple(getattr(row, c) for c in SA)
            if key != current:
                current, reached, first_id = key, _BEFORE_FIRST, int(row.first_id)
            rows.append((*key, int(row.chunk), reached, first_id))
            reached = apply_transfer(list(row.bounds), list(row.results), reached)
        if rows:
            yield pd.DataFrame(rows, columns=[*SA, "chunk", "sequence_number", "first_id"])


def _anomalies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["packet_id", "sequence_number", "first_id"]
    for key, block in _blocks(frames, [*SA, "chunk"], columns):
        # row 0 is the marker with the entry maximum and the first packet of the SA
        sequence = block["sequence_number"][1:]
        mask = scan_block(sequence, int(block["sequence_number"][0]))
        if mask.any():
            hit = {"packet_id": block["packet_id"][1:][mask], "sequence_number": sequence[mask]}
            sa = dict(zip(SA, key, strict=False))
            yield pd.DataFrame({**sa, **hit, "sa_first_id": int(block["first_id"][0])})


def sequence_observations(esp: DataFrame, ah: DataFrame) -> DataFrame:
    """ESP and AH packets with a sequence number, tagged with their table."""
    columns = ["capture_id", "spi", "direction", "packet_id", "sequence_number"]
    tables = [
        t.where("sequence_number IS NOT NULL").select(*columns).withColumn("source_table", F.lit(name))
        for name, t in (("esp_packets", esp), ("ah_packets", ah))
    ]
    return tables[0].unionByName(tables[1])


def replay_anomalies(observed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every packet whose sequence number does not rise within its SA."""
    keys = [*SA, "chunk"]
    rows = observed.select(
        *SA, chunk_of(F.col("packet_id"), chunk_rows).alias("chunk"), "packet_id", "sequence_number"
    )
    summaries = (
        rows.repartition(*keys)
        .sortWithinPartitions(*keys, "packet_id")
        .mapInPandas(
            _summaries,
            f"{_KEY_DDL}, chunk bigint, first_id bigint, bounds array<bigint>, results array<bigint>",
        )
    )
    entries = (
        summaries.repartition(*SA)
        .sortWithinPartitions(*SA, "chunk")
        .mapInPandas(_entries, f"{_KEY_DDL}, chunk bigint, sequence_number bigint, first_id bigint")
    )
    # each block starts with one marker row carrying its entry maximum
    marked = rows.withColumn("first_id", F.lit(0).cast("bigint")).unionByName(
        entries.withColumn("packet_id", F.lit(-1).cast("bigint"))
    )
    return (
        marked.repartition(*keys)
        .sortWithinPartitions(*keys, "packet_id")
        .mapInPandas(
            _anomalies,
            f"{_KEY_DDL}, packet_id bigint, sequence_number bigint, sa_first_id bigint",
        )
    )


def first_anomalies(anomalies: DataFrame, limit: int = SHOWN_ANOMALIES) -> DataFrame:
    """Anomalies to show: SAs by their first packet, then packet order, ``limit`` per table.

    The rank filter is pushed below the shuffle, so a table's anomalies do not meet in one task.
    """
    order = Window.partitionBy("capture_id", "source_table").orderBy(
        "sa_first_id", "spi", "direction", "packet_id"
    )
    ranked = anomalies.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= limit)
