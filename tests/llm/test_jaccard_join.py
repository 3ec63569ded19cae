from __future__ import annotations

import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import components, jaccard_join
from flowlens.llm.prefix_tree import PrefixTree


def test_tree_finds_what_comparison_finds():
    r = random.Random(2)
    base = [sorted(r.sample(range(300), r.randrange(1, 60))) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(8):
            own = set(b) - set(r.sample(b, min(len(b), r.randrange(4))))
            sets.append(sorted(own | set(r.sample(range(300), r.randrange(4)))) or [1])
    sets += [sets[0], sets[1]]
    arrays = [np.array(s, dtype="u8") for s in sets]
    for percent in (50, 75, 100):
        tree = PrefixTree(arrays, percent)
        for probe in arrays:
            a = set(probe.tolist())
            expected = [
                i for i, s in enumerate(sets) if 100 * len(a & set(s)) >= percent * len(a | set(s))
            ]
            assert sorted(tree.matches(probe)) == expected
    assert list(PrefixTree([], 75).matches(arrays[0])) == []


def test_components(spark):
    links = [(5, 2), (2, 9), (9, 5), (7, 7), (20, 21), (21, 22), (22, 23), (30, 1), (1, 40)]
    links += [(100 + i, 101 + i) for i in range(40)]
    out = components.connected(spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["label"] for r in out.collect()}
    expected = {5: 2, 9: 2, 21: 20, 22: 20, 23: 20, 30: 1, 40: 1} | {101 + i: 100 for i in range(40)}
    assert got == expected


def _counted(monkeypatch) -> list[str]:
    """Names of the tables that components stores from now on."""
    names, store = [], components.store
    monkeypatch.setattr(components, "store", lambda df, name: names.append(name) or store(df, name))
    return names


def test_components_of_few_links_need_no_round(spark, monkeypatch):
    stored = _counted(monkeypatch)
    links = [(100 + i, 101 + i) for i in range(40)] + [(7, 3), (9, 7), (9, 3), (4, 4), (3, 7)]
    out = components.connected(spark.createDataFrame(links, "a long, b long").coalesce(1))
    got = sorted((r["node"], r["label"]) for r in out.collect())
    assert got == [(7, 3), (9, 3)] + [(101 + i, 100) for i in range(40)]
    assert len(stored) == 1
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_across_chunks(spark, monkeypatch):
    stored = _counted(monkeypatch)
    monkeypatch.setattr(components, "CHUNK", 1)  # of the Arrow batches, each of three rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        links = [(i, i // 2) for i in range(1, 200)] + [(500 + i, 502 + i) for i in range(60)] + [(560, 561)]
        out = components.connected(spark.createDataFrame(links, "a long, b long"))
        got = sorted((r["node"], r["label"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i, 0) for i in range(1, 200)] + [(501 + i, 500) for i in range(61)]
    assert len(stored) > 1


def test_chunks_become_stars():
    r = random.Random(3)
    for n in (0, 1, 5, 40, 300):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        low = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        a, b = components._stars(ends[:, 0], ends[:, 1])
        assert list(zip(a.tolist(), b.tolist())) == [(i, x) for i, x in enumerate(low) if x != i]


def test_links_are_stored_once(spark, monkeypatch):
    names, store = [], jaccard_join.store
    monkeypatch.setattr(jaccard_join, "store", lambda df, name: names.append(name) or store(df, name))
    docs = spark.createDataFrame(_near_copies(2, 10, 4), "doc_id long, text string")
    jaccard_join.near_duplicates(docs).collect()
    assert "links" not in names  # components store them


def test_probe_reads_its_pairs_twice(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard_join, "TREE", 2)
    monkeypatch.setattr(jaccard_join, "PROBES", 1)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text + f" {i}" if i < 6 else f"other {i} " * 9) for i in range(9)]
    pairs = [(1, i, True) for i in (2, 3, 4, 5, 6)] + [(1, 1, False), (1, 7, False), (1, 0, False)]
    pairs += [(8, 0, True), (8, 2, True), (7, 3, False)]  # keys with one side only
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame(pairs, "key long, id long, tree boolean").write.parquet(f"{tmp_path}/pairs")
    none = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
    tables = [spark.read.parquet(f"{tmp_path}/{t}") for t in ("texts", "pairs")]
    links = jaccard_join.probe(*tables, spark.sparkContext.broadcast(none), 5, 75)
    got = sorted((r["a"], r["b"]) for r in links.distinct().collect())
    assert got == sorted((a, b) for a in (0, 1) for b in (2, 3, 4, 5))
    assert links._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 3


def _near_copies(seed: int, groups: int, size: int):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    docs, ids = [], list(range(1000))
    r.shuffle(ids)
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice((3, 8, 40, 120)))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((ids.pop(), " ".join(w) + (" " + passage if r.random() < 0.3 else "")))
    return docs


EDGES = [
    (2001, None), (2002, ""), (2003, " \n"), (2004, "one two"), (2005, "ONE two"), (2006, "one"),
    (None, "alpha beta gamma delta epsilon zeta"), (None, "another text without any id at all"),
    (2007, "Alpha beta gamma delta epsilon zeta"),
    (2008, "first row of a repeated id here"), (2008, "second row of a repeated id, other text"),
    (2009, "second row of a repeated id, other text"),
]


def found(spark, docs, **kwargs):
    table = spark.createDataFrame(
        [(d, t, 1, "x") for d, t in docs], "doc_id long, text string, id int, gram string"
    )
    out = jaccard_join.near_duplicates(table, **kwargs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("percent", [75, 40])
def test_equals_all_pairs(spark, percent):
    docs = _near_copies(7, 25, 9) + EDGES
    assert found(spark, docs, percent=percent) == sorted(plain.components(docs, percent), key=repr)


def test_group_with_many_leaders(spark, monkeypatch):
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(2000)]
    base = [r.choice(vocabulary) for _ in range(100)]
    docs = []
    for i in range(90):  # copies of which about a quarter of all pairs link
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(100)] = r.choice(vocabulary)
        docs.append((i * 3 % 91, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "TREE", 8)
    monkeypatch.setattr(jaccard_join, "PROBES", 5)
    assert found(spark, docs) == sorted(plain.components(docs), key=repr)


def _templates(n: int, own: int, seed: int = 4):
    """Documents of one page frame with words of their own."""
    r = random.Random(seed)
    frame = [f"f{i}" for i in range(200)]
    return [(i, " ".join(frame + [f"w{r.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_crowded_ngrams(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED", 3)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "TREE", 8)
    monkeypatch.setattr(jaccard_join, "PROBES", 5)
    docs = []
    for k, own in enumerate((36, 44, 60)):  # frames alone do not link
        docs += [(100 * k + i, text) for i, text in _templates(12, own, k)]
    docs += [(1000 + i, t) for i, (_, t) in enumerate(_near_copies(3, 6, 5))]
    # four of each kind, so that all their n-grams are frequent and no order puts the frame last
    kinds = _templates(9, 40, 8) + [(9 + i, t) for i, t in _templates(3, 33, 9)]
    docs += [(2000 + 10 * i + k, f"{text} x{k}") for i, text in kinds for k in range(4)]
    crowds = []
    before = jaccard_join._crowds
    monkeypatch.setattr(jaccard_join, "_crowds", lambda *a: crowds.append(before(*a)) or crowds[-1])
    assert found(spark, docs) == sorted(plain.components(docs), key=repr)
    assert crowds and crowds[0].where("tree").count() and crowds[0].where("not tree").count()


def test_frames_that_cannot_link_meet_in_no_cell(spark):
    frequent = spark.sparkContext.broadcast((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    docs = spark.createDataFrame(_templates(150, 44), "id long, text string")
    rests = jaccard_join._rests(docs, frequent, 5, 75)
    assert rests.count() > 150 * 60  # in no order that puts frames last, most share what comes first
    frames = [g for _, text in _templates(2, 0) for g in dict(jaccard_join.grams_of(_column(text), 5)).values()]
    heads = np.unique(jaccard_join._head(frames[0]))
    frequent = spark.sparkContext.broadcast((heads, np.full(len(heads), 150)))
    rests = jaccard_join._rests(docs, frequent, 5, 75).withColumn("comp", F.col("id"))
    assert jaccard_join._cells(rests, 75).count() == 0


def _column(text: str):
    return pa.array([text])


def test_empty_table(spark):
    assert found(spark, []) == []


class _Tasks:
    """Stands for a frame and keeps the functions given to it."""

    def mapInArrow(self, task, schema):
        self.task = task
        return self

    def groupBy(self, *columns):
        return self

    def applyInArrow(self, task, schema):
        return self


def test_tasks_deal_out_what_they_hold_within_a_batch(monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 200)
    monkeypatch.setattr(jaccard_join, "_narrow", lambda docs: docs)
    texts = [" ".join(f"w{100 * i + k}" for k in range(50)) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(60)), "text": texts})

    described = _Tasks()
    jaccard_join.describe(described, 5, 75)
    rows = [r for b in described.task(iter([batch])) for r in b.to_pylist()]
    heads = [len(r["heads"]) // 4 for r in rows if r["heads"] is not None]
    assert sum(heads) == 60 * 46 and len({r["id"] for r in rows} - {None}) == 60

    class Frequent:
        value = (np.zeros(0, "u4"), np.zeros(0, "i8"))

    dealt = _Tasks()
    jaccard_join.prefixes(dealt, Frequent, 5, 75, 4)
    held = [sum(len(x) // 8 for x in b["grams"].to_pylist()) for b in dealt.task(iter([batch]))]
    assert len(held) > 1 and max(held) <= 200 + 46

    flushes = [b for b in described.task(iter([batch])) if b["heads"].null_count < len(b)]
    assert len(flushes) > 1
    assert max(sum(len(x) // 4 for x in b["heads"].to_pylist()) for b in flushes) <= 200 + 46


def test_texts_reach_tasks_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), {}
    store = jaccard_join.store
    monkeypatch.setattr(
        jaccard_join, "store", lambda df, name: seen.setdefault(name, int(spark.conf.get(key))) and store(df, name)
    )
    table = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string")
    jaccard_join.near_duplicates(table)
    reading = ("jaccard-described", "jaccard-prefixes")
    assert all(seen[name] <= jaccard_join.BATCH_ROWS for name in reading)
    assert spark.conf.get(key) == before
