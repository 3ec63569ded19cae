from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import shipping  # noqa: E402

from flowlens.llm import (  # noqa: E402
    decontaminate,
    hard_negatives,
    html_text,
    jaccard_join,
    line_dedup,
    run_detection,
    sentencepiece,
    token_counts,
    topk_search,
    unit_dedup,
)
from flowlens.llm.resources import tokenizer_file  # noqa: E402


def test_task_functions_need_no_install(spark, monkeypatch, tmp_path):
    functions = shipping.record(monkeypatch)
    docs = spark.createDataFrame([(1, "some words here"), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    model = tokenizer_file("piece_bpe_32k.model")
    frequent = jaccard_join._frequent(jaccard_join.describe(docs, 5, 75))
    frequent = spark.sparkContext.broadcast(frequent)
    jaccard_join.prefixes(docs, frequent, 5, 75, 4)
    texts = docs.withColumnRenamed("doc_id", "id")
    jaccard_join._rests(texts, frequent, 5, 75)
    pairs = spark.createDataFrame([(1, 1, True), (1, 2, False)], "key long, id long, tree boolean")
    jaccard_join.probe(texts, pairs, frequent, 5, 75)
    decontaminate.find_contamination(docs, items)
    line_dedup.dedup_lines(docs)
    unit_dedup.dedup_units(docs)
    html_text.extract_text(docs, "text", "seen")
    run_detection.find_runs(docs)
    sentencepiece.decode(sentencepiece.encode(docs, model), model)
    token_counts.count_tokens(docs, token_counts.zipf_scores(token_counts.ranked_pieces(model)))
    vectors = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 2)], "vec_id long, embedding array<double>, label int")
    topk_search.top_k(vectors, F.lit(True))
    hard_negatives.mine(vectors, F.lit(True))
    assert len(functions) >= 24
    shipping.load_elsewhere(functions, tmp_path)
