from __future__ import annotations

import numpy as np
import plain

from flowlens.llm import line_dedup
from flowlens.llm.minimal_hash import LineIndex


def test_minimal_hash_numbers_every_key_once():
    rng = np.random.default_rng(3)
    low, high = (rng.integers(0, 2**63, 5000).astype("u8") for _ in range(2))
    index = LineIndex.load(LineIndex.of(low, high, np.arange(5000), np.arange(5000) * 7).dump())
    assert sorted(index.slots(low, high)) == list(range(5000))
    known, counts, firsts = index.probe(low, high)
    assert known.all() and (counts == np.arange(5000)).all() and (firsts == counts * 7).all()
    assert not index.probe(high, low)[0].any()
    assert not LineIndex.of(low[:0], high[:0], [], []).probe(low, high)[0].any()


CASES = [
    (3, "Same line here \nown line of three\n\nshort"),
    (1, "  SAME LINE HERE\nown line of one, longer\nshort"),
    (None, "same line here\nline of no id at all"),
    (None, "line of no id at all\nsame Line here"),
    (5, None),
    (6, ""),
    (7, "repeated in itself\nrepeated in itself\nÉCLAIR ligne accentuée"),
    (8, "éclair ligne accentuée\nrepeated in itself \nÉCLAIR ligne accentuée"),
    (8, "same id, another row\nsame line here"),
    (9, "x" * 200_000 + "\n" + "same line here\n" * 2000),
]


def found(spark, rows, **kwargs):
    docs = spark.createDataFrame(
        [(d, t, "a", 1, "b") for d, t in rows],
        "doc_id long, text string, id string, n_lines int, drops string",
    )
    out = line_dedup.dedup_lines(docs, **kwargs)
    assert out.columns == ["doc_id", "text", "id", "drops", "n_lines", "n_dropped"]
    return sorted(
        ((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=repr
    )


def test_edge_cases(spark):
    assert found(spark, CASES) == sorted(plain.dedup_lines(CASES), key=repr)


def test_small_shards(spark):
    rows = [(i, "\n".join(f"line number {(i * k) % 37}" for k in range(9))) for i in range(60)]
    rows += [(100 + i, "a line in every document\nline number 3") for i in range(60)]
    assert found(spark, rows, shard_keys=2) == sorted(plain.dedup_lines(rows), key=repr)


def test_empty_table(spark):
    assert found(spark, []) == []
