"""The subpackage's queries: SQL where there is some, else whole results with stable columns."""

from __future__ import annotations

import pytest

from flowlens.llm import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    database = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
        database.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = database.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    found = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("name", "table"), [
    ("op1_html_extraction", "pages"), ("op5_substring_dedup", "documents"),
    ("op7_quality_rules", "documents"), ("op8_token_counts", "documents"),
    ("op10_sentencepiece", "documents"),
])
def test_query_answers_every_row(spark, name, table):
    key = "page_id" if table == "pages" else "doc_id"
    found = [r[key] for r in queries.QUERIES[name](spark, FOLDER).collect()]
    rows = [r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()]
    assert sorted(found) == sorted(rows)
