"""Corpus pipeline: rules, line dedup, near copies, benchmark passages, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; all but the last return the
columns of ``docs``. ``n_chars`` follows the text where a stage changes it. Stages define their
results for nulls, repeats and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, jaccard_join, line_dedup, quality_rules, sentencepiece
from flowlens.llm.resources import tokenizer_file
from flowlens.session import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    fitted = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules.judge(docs, fitted, "quality_verdict_")
    return judged.where("quality_verdict_.kept").select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.char_length("text").cast(kind))
    return kept.select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows that share an id stay or go together; rows without an id stay.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, items)
    return found.where(~decontaminate.contaminated()).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the piece ids of their text in ``pieces``."""
    return sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", tokens),
]

#: the quality verdict and the tokens have no SQL form; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, last = STAGES
    for name, stage in first:
        docs = store(stage(spark, docs, sf_dir), name)
    return last[1](spark, docs, sf_dir)
