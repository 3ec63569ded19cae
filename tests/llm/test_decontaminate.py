from __future__ import annotations

import random

import numpy as np
import plain
import pyarrow as pa

from flowlens.llm import decontaminate
from flowlens.llm import words as W
from flowlens.llm.fm_index import FMIndex


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, n) for n in (0, 1, 300, 300, 7, 0, 50)]
    texts[3] = texts[2].copy()  # equal texts must not run into each other
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = FMIndex(np.concatenate(texts).astype("u8"), bounds, sample=5)
    phrases = [list(rng.integers(0, 5, rng.integers(1, 9))) for _ in range(200)]
    matrix = np.zeros((200, 8), "u8")
    for i, p in enumerate(phrases):
        matrix[i, : len(p)] = p
    low, high = index.search(matrix, np.array([len(p) for p in phrases]))
    for i, p in enumerate(phrases):
        text, at = index.locate(np.arange(low[i], high[i]))
        expected = [
            (t, k)
            for t, own in enumerate(texts)
            for k in range(len(own) - len(p) + 1)
            if list(own[k : k + len(p)]) == p
        ]
        assert sorted(zip(text.tolist(), at.tolist(), strict=True)) == expected


def _sample():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünïcode", "x1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(12)]
    items += [(20, "Short Item"), (21, ""), (22, None), (23, items[0][1]), (None, "w1 w2")]
    docs = []
    for i in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randrange(200))]
        if i % 3 == 0:
            own = items[i % 12][1].split()
            at = r.randrange(len(w) + 1)
            w[at:at] = own[: r.randrange(5, 30)]
        docs.append((i, ", ".join(w)))
    docs += [(90, None), (91, ""), (91, "short\nITEM short item"), (None, items[3][1].upper())]
    docs += [(92, " ".join(r.choice(vocabulary) for _ in range(5000)) + " " + items[5][1])]
    return docs, items


def found(spark, docs, items, **kwargs):
    table = spark.createDataFrame(
        [(d, t, "a", [1]) for d, t in docs], "doc_id long, text string, items string, ranges array<int>"
    )
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    out = decontaminate.find_contamination(table, bench, **kwargs)
    assert out.select("row.*").columns == table.columns
    return out.collect()


def test_equals_a_scan(spark):
    docs, items = _sample()
    expected = plain.contamination(docs, [x for x in items if x[0] is not None])
    for kwargs in ({}, {"phrase_bytes": 300}):
        rows = found(spark, docs, items, **kwargs)
        got = [(r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
        for r in rows:
            text = r["row"]["text"] or ""
            inside = sum(
                len(plain.contamination([(0, text[s["start"] : s["end"]])], [])[0:1])
                and plain.contamination([(0, text[s["start"] : s["end"]])], [])[0][1]
                for s in r["spans"]
            )
            assert inside == r["n_hit"]


def test_blocks_hold_every_window_and_item(spark):
    _, items = _sample()
    items = [*items, *[(100 + i, items[0][1]) for i in range(50)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i), t) for i, t in items if i is not None and t is not None]
    whole = decontaminate.phrases_of([i for i, _ in named], [t for _, t in named])

    def pairs(phrases):
        return {
            (phrases.windows[k, : phrases.sizes[k]].tobytes(), item)
            for k in range(len(phrases.sizes))
            for item in phrases.items[phrases.bounds[k] : phrases.bounds[k + 1]]
        }

    for most in (1 << 20, 2000):
        blocks = decontaminate.phrase_blocks(bench, decontaminate.WINDOW, most).collect()
        found = [pairs(decontaminate._unpacked(b, decontaminate.WINDOW)) for b in blocks]
        assert set().union(*found) == pairs(whole) and sum(map(len, found)) == len(pairs(whole))
        assert len(blocks) > 3 if most == 2000 else len(blocks) == 1


def test_blocks_do_not_follow_the_number_of_partitions(spark, monkeypatch):
    _, items = _sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = type(bench).repartition

    def more(self, n, *columns):
        return before(self, max(n, 40) if columns and isinstance(n, int) else n, *columns)

    monkeypatch.setattr(type(bench), "repartition", more)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert decontaminate.phrase_blocks(bench, decontaminate.WINDOW, 1 << 20).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_passes_store_hits_only(spark, monkeypatch):
    docs, items = _sample()
    names = []
    before = decontaminate.store
    monkeypatch.setattr(decontaminate, "store", lambda df, name: names.append((name, df.columns)) or before(df, name))
    found(spark, docs, items, phrase_bytes=300)
    assert sum(n == "decontaminate-rows" for n, _ in names) == 1
    assert all(c == ["at", "items", "ranges"] for n, c in names if n == "decontaminate-hits")


def test_pieces_of_a_long_text_change_nothing():
    docs, items = _sample()
    phrases = decontaminate.phrases_of([str(i) for i, _ in items], [t for _, t in items])
    data, bounds = W.column_bytes(pa.array([t for _, t in docs], pa.string()))
    data = W.LOWER[data]
    whole = decontaminate.find_hits(data, bounds, phrases)
    small = decontaminate.find_hits(data, bounds, phrases, piece=30)
    assert ((np.cumsum(whole[1]) > 0) == (np.cumsum(small[1]) > 0)).all()
    assert (whole[2] == small[2]).all()


def test_empty_tables(spark):
    docs, items = _sample()
    assert found(spark, [], items) == []
    assert {r["n_hit"] for r in found(spark, docs[:3], [])} == {0}
