from __future__ import annotations

import plain
import pytest

from flowlens.llm import quality_rules

FOLDER = "/root/testdata/sf0.001"
CASES = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, "a " * 40), (5, "x #y <z>\n\nx #y <z>\nÄ ö"),
    (6, " ".join(map(str, range(30)))), (6, " ".join(map(str, range(30)))), (None, "no id " * 9),
    (7, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(5, 20)))),
    (8, " ".join(str(i % 977) for i in range(30_000))), (9, "one\x0btwo\x0cthree\r\nfour"),
]


def judged(spark, docs, labels, **kwargs):
    table = spark.createDataFrame(
        [(d, t, "a", 1, "b") for d, t in docs],
        "doc_id long, text string, split_ string, words int, counts_ string",
    )
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    fitted = quality_rules.fit(table, marks, **kwargs)
    out = quality_rules.judge(table, fitted)
    assert out.columns == [*table.columns, "verdict"]
    return fitted, [(r["doc_id"], r["text"], r["verdict"]) for r in out.collect()]


def test_base_counts_and_no_labels(spark):
    fitted, rows = judged(spark, CASES, [])
    assert fitted.weights is None and len(rows) == len(CASES)
    for _, text, v in rows:
        n, chars, symbols, lines, repeats = plain.base_counts(text)
        assert (n, chars, symbols, lines, repeats) == (
            v["n_words"], v["word_chars"], v["n_symbols"], v["n_dup_lines"], v["n_repeat_words"],
        )
        assert v["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert v["kept"] == (not v["base_failed"]) and v["score"] is None


def test_empty_table(spark):
    assert judged(spark, [], [(1, 1)])[1] == []


def test_verdict_equals_plain_version(spark):
    pytest.importorskip("pyarrow")
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").collect()]
    labels += [(None, 1), (5, None), (10**9, 0), labels[0]]
    _, rows = judged(spark, docs, labels)
    expected = plain.quality(docs, labels, quality_rules.BUCKETS, quality_rules.TAIL)
    got = {d: v for d, _, v in rows}
    quality = dict(labels[:-4])
    for (doc, _), (score, kept) in zip(docs, expected, strict=True):
        assert got[doc]["score"] == pytest.approx(score, abs=1e-8)
        assert got[doc]["kept"] == kept
        if quality.get(doc) == 0:
            assert not kept


def test_sample_bound(spark):
    docs = [(i, f"good words here number {i} " * 6) for i in range(40)]
    fitted, _ = judged(spark, docs, [(i, i % 2) for i in range(40)], sample=3)
    assert fitted.weights is not None
