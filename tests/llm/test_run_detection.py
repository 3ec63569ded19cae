from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from flowlens.llm import queries, re_pair, run_detection

FOLDER = "/root/testdata/sf0.001"


def plain(words, least=24, times=3):
    """All runs of a word list as (start, length, period), comparing every word with every other."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def _texts(seed):
    r = random.Random(seed)
    out = []
    for k in range(40):
        letters = r.choice([1, 2, 3, 5, 50])
        text = [r.randrange(letters) for _ in range(r.randrange(150))]
        if k % 4 == 1:  # a run of whole and part periods
            period = [r.randrange(letters) for _ in range(r.randrange(1, 12))]
            text = text[:20] + period * r.randrange(2, 12) + period[: r.randrange(len(period))] + text[:9]
        elif k % 4 == 2:  # runs within the period of a run
            text = ([r.randrange(letters)] * r.randrange(3, 40) + [77]) * r.randrange(2, 6)
        elif k % 4 == 3:  # copies share nonterminals
            text = list(r.choice(out))
        out.append(text)
    a, b = [1], [1, 0]
    for _ in range(9):
        a, b = b, b + a
    return [*out, b, [], [5] * 3000]


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (10, 4)])
def test_equals_plain_version(least, times):
    texts = _texts(least)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.array([w * 7919 + 13 for t in texts for w in t], dtype=np.uint64)
    got = run_detection.find(words, bounds, least, times)
    expected = [(i, a + bounds[i], n, q) for i, t in enumerate(texts) for a, n, q in plain(t, least, times)]
    assert [tuple(x) for x in got.tolist()] == expected and len(expected) > 50


def test_pairs_of_places_in_shares(monkeypatch):
    monkeypatch.setattr(run_detection, "PAIRS", 10)
    test_equals_plain_version(24, 3)


def test_nonterminals_derive_equal_words():
    texts = _texts(5)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.array([w for t in texts for w in t], dtype=np.uint64)
    nodes = re_pair.grammar(words, bounds, 2)
    derived = {}
    for symbol, start, left, size in zip(*nodes, strict=True):
        own = tuple(words[start : start + size])
        assert 0 < left < size
        assert derived.setdefault(symbol, (own, left)) == (own, left)
    whole = {(n.start, n.start + n.size) for n in (re_pair.Nodes(*x) for x in zip(*nodes, strict=True))}
    assert all((a, b) in whole for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1)


def test_odd_tables(spark):
    schema = "doc_id long, text string, runs string, n int"
    again = "a b " * 20
    rows = [
        (1, f"x  {again}\ny", "r", 1), (1, again, None, None), (None, "wörd\t" * 30, "r", 2),
        (2, None, "r", 3), (3, "", "r", 4), (4, " \n", "r", 5), (5, "one two", "r", 6), (6, "q " * 200_000, "r", 7),
    ]
    out = run_detection.find_runs(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "n", "runs", "strongest"]
    got = {r["n"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for _, text, _, n in rows:
        words = split(text)
        runs = plain(words) if n != 7 else [(0, 200_000, 1)]
        assert [tuple(x) for x in got[n]["runs"]] == runs
        assert got[n]["text"] == collapsed(words, runs)
        best = max(runs, key=lambda x: x[1] / x[2], default=None)
        assert got[n]["strongest"] == best
    assert run_detection.find_runs(spark.createDataFrame([], schema)).collect() == []


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected, found = {}, 0
    for doc in docs:
        words = split(doc["text"])
        h, n = zlib.crc32(str(doc["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain(words)
        found += len(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        texts = "".join(f"{a},{n},{q}\n" for a, n, q in runs), collapsed(words, runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        expected[doc["doc_id"]] = (len(runs), *best, milli, *digests)
    got = {r[0]: tuple(r[1:]) for r in queries.op11_run_detection(spark, FOLDER).collect()}
    assert got == expected and found > 5


def test_texts_without_words_are_not_made_periodic(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, t) for i in ids[:4] for t in (None, "", " \n", "one", "a b")] + [(None, "x y z"), (None, None)]
    out = queries.periodic(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or -1, split(r["text"])[:1]) for r in out)
    assert got == sorted((i or -1, split(t)[:1]) for i, t in rows)
