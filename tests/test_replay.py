from __future__ import annotations

import random

import numpy as np
import pytest
from flowlens.operators import replay

WRAP = 1 << 31


def model(sequence: list[int], entry: int | None) -> tuple[list[bool], int | None]:
    flags, top = [], entry
    for q in sequence:
        if top is None or top - q > WRAP or q > top:
            flags.append(False)
            top = q
        else:
            flags.append(True)
    return flags, top


def draws(rng: random.Random, n: int) -> list[int]:
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(1 << 32) for _ in range(n)]
    if kind == 1:
        start = rng.randrange(1 << 32)
        return [(start + 3 * i) % (1 << 32) for i in range(n)]
    if kind == 2:
        start = (1 << 32) - 50
        return [(start + i * 7 - rng.randrange(12)) % (1 << 32) for i in range(n)]
    return [max(0, (1 << 31) - 40 * i + rng.randrange(60)) for i in range(n)]


def test_block_functions_equal_the_scan():
    rng = random.Random(3)
    for _ in range(1500):
        block = draws(rng, rng.randrange(1, 25))
        entry = rng.choice([None, rng.randrange(1 << 32), block[0], (1 << 32) - 1, 0])
        flags, top = model(block, entry)
        array, start = np.array(block, dtype=np.int64), -1 if entry is None else entry
        assert replay.scan_block(array, start).tolist() == flags
        assert replay.apply_transfer(*replay.transfer_function(array), start) == top


def test_rising_block_stays_small():
    bounds, _ = replay.transfer_function(np.arange(1, 60001, dtype=np.int64))
    assert len(bounds) <= 3


@pytest.mark.parametrize("chunk_rows", [7, 50, 65536])
def test_distributed_scan_equals_the_scan(spark, chunk_rows):
    rng = random.Random(11)
    rows, expected = [], set()
    for name in ("a", "b", "c", "d"):
        sequence = draws(rng, 150)
        flags, _ = model(sequence, None)
        ids = sorted(rng.sample(range(1, 400), 150))
        for i, q, bad in zip(ids, sequence, flags, strict=True):
            rows.append(("cap", "esp_packets", name, "upstream", i, q))
            if bad:
                expected.add((name, i))
    ddl = "capture_id string, source_table string, spi string, direction string, packet_id long, sequence_number long"
    found = replay.replay_anomalies(spark.createDataFrame(rows, ddl), chunk_rows).collect()
    assert {(r["spi"], r["packet_id"]) for r in found} == expected


@pytest.mark.parametrize(
    ("sequence", "expected"),
    [
        ([1, 2, 2, 4], [3]),
        ([5, 5], [2]),
        ([4_000_000_000, 100], []),
        ([2_000_000_000, 100], [2]),
    ],
)
def test_known_sequences(spark, sequence, expected):
    rows = [("c", "ah_packets", "s", "upstream", i + 1, q) for i, q in enumerate(sequence)]
    ddl = "capture_id string, source_table string, spi string, direction string, packet_id long, sequence_number long"
    found = replay.replay_anomalies(spark.createDataFrame(rows, ddl)).collect()
    assert [r["packet_id"] for r in found] == expected


def test_only_the_shown_anomalies_are_capped(spark):
    rows = [("c", "esp_packets", "s", "upstream", i + 1, 9) for i in range(30)]
    ddl = "capture_id string, source_table string, spi string, direction string, packet_id long, sequence_number long"
    found = replay.replay_anomalies(spark.createDataFrame(rows, ddl))
    assert found.count() == 29
    assert replay.first_anomalies(found, 25).count() == 25
