from __future__ import annotations

import corpus_pipeline
import plain

from flowlens.llm import quality_rules
from flowlens.llm.resources import tokenizer_file

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_plain_version(spark):
    import sentencepiece as library

    tables = {
        t: spark.read.parquet(f"{FOLDER}/{t}.parquet").collect() for t in ("documents", "labels", "benchmark")
    }
    docs = [(r["doc_id"], r["text"]) for r in tables["documents"]]
    labels = [(r["doc_id"], r["quality"]) for r in tables["labels"]]
    verdicts = plain.quality(docs, labels, quality_rules.BUCKETS, quality_rules.TAIL)
    docs = [d for d, (_, kept) in zip(docs, verdicts, strict=True) if kept]
    docs = [(d, text) for d, _, _, text in plain.dedup_lines(docs)]
    docs = [d for d, (_, _, c) in zip(docs, plain.components(docs), strict=True) if d[0] == c]
    items = [(r["item_id"], r["text"]) for r in tables["benchmark"]]
    found = plain.contamination(docs, items)
    docs = [d for d, (_, n, hit, _) in zip(docs, found, strict=True) if not (hit and 20 * hit >= n)]
    model = library.SentencePieceProcessor(model_proto=tokenizer_file("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces"]
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["pieces"]) for r in out.collect()}
    assert got == {d: (t, len(t), model.encode(t)) for d, t in docs}


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, verdict string"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, text, "en", None, None, "a"), (2, text.upper(), None, "s", 1, "b"), (3, None, "x", "y", 0, "c"),
        (None, text + " and more", "en", "s", 9, "d"), (4, "", "x", "y", 0, "e"), (1, text, "en", None, None, "a"),
    ]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[: len(table.columns)] == table.columns
            if k < 4:
                assert docs.columns == table.columns
        ids = sorted((r["doc_id"] for r in docs.collect()), key=repr)
        assert ids == ([1, 1, 2, None] if table.count() else [])  # 2 has lost its only line
