from __future__ import annotations

import random
from pathlib import Path

import plain
import pytest

from flowlens.llm import sentencepiece, token_counts
from flowlens.llm.resources import TOKENIZERS, tokenizer_file

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).is_dir(), reason="no vocabulary files")
MODEL = "piece_bpe_32k.model"
CASES = [
    None, "", " ", "   three", "a", "Hello   world\n\tfoo ﬁ é 𝔘", "▁mark ▁", "日本語のテキスト",
    "        def f():\n            return 1  ", "\x00\x01", "=" * 70, "aaaaaaaaaaaaaaaaaaaa", "x" * 50_000,
]


def _texts() -> list[str | None]:
    r = random.Random(6)
    letters = "ab t\n  .é日x1=-thein"
    return CASES + ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(400)]


def _documents(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def _table(spark, texts):
    return spark.createDataFrame(
        [(i, t, "p", 1) for i, t in enumerate(texts)], "doc_id long, text string, pieces string, n_tokens int"
    )


def test_encoding_equals_the_library(spark):
    library = pytest.importorskip("sentencepiece")
    model = tokenizer_file(MODEL)
    texts = _texts() + _documents(spark)
    both = sentencepiece.decode(sentencepiece.encode(_table(spark, texts), model), model)
    assert both.columns == ["doc_id", "text", "n_tokens", "pieces", "decoded"]
    rows = {r["doc_id"]: r for r in both.collect()}
    expected = library.SentencePieceProcessor(model_proto=model).encode([t or "" for t in texts])
    for i, text in enumerate(texts):
        assert rows[i]["pieces"] == expected[i], repr(text)[:100]
        if "▁" not in (text or ""):
            assert rows[i]["decoded"] == (text or "")


def test_words_are_remembered_within_bounds(monkeypatch):
    import pyarrow as pa

    from flowlens.llm import words as W

    vocabulary = sentencepiece.Vocabulary.load(tokenizer_file(MODEL))
    data, bounds = W.column_bytes(pa.array(_texts(), pa.string()))
    whole = sentencepiece.Encoder(vocabulary).texts(data, bounds)[0].tolist()
    monkeypatch.setattr(sentencepiece, "KNOWN_WORDS", 10)
    monkeypatch.setattr(sentencepiece, "BLOCK_BYTES", 50)
    small = sentencepiece._encoded(sentencepiece.Encoder(vocabulary), pa.array(_texts(), pa.string()))
    assert small.flatten().to_pylist() == whole


def test_empty_tables(spark):
    model = tokenizer_file(MODEL)
    assert sentencepiece.encode(_table(spark, []), model).collect() == []
    assert token_counts.count_tokens(_table(spark, []), {b" a": -1.0}).collect() == []


def test_counts_equal_plain_program(spark):
    scores = token_counts.zipf_scores(token_counts.ranked_pieces(tokenizer_file(MODEL)))
    byte = min(scores.values()) - token_counts.BYTE_PENALTY

    def best(word: str, known={}) -> int:  # noqa: B006
        if word not in known:
            raw = b" " + word.encode()
            cut = [(0.0, 0)]
            for j in range(1, len(raw) + 1):
                options = [(cut[j - 1][0] + byte, -cut[j - 1][1] - 1)]
                for i in range(max(0, j - 50), j):
                    if raw[i:j] in scores:
                        options.append((cut[i][0] + scores[raw[i:j]], -cut[i][1] - 1))
                top = max(options)
                cut.append((top[0], -top[1]))
            known[word] = cut[-1][1]
        return known[word]

    texts = [t for t in _texts() if t is None or len(t) < 10_000] + _documents(spark)[:40]
    out = token_counts.count_tokens(_table(spark, texts), scores)
    assert out.columns == ["doc_id", "text", "pieces", "n_pretokens", "n_tokens"]
    for r in out.collect():
        own = plain.words(texts[r["doc_id"]])
        assert (r["n_pretokens"], r["n_tokens"]) == (len(own), sum(map(best, own)))
