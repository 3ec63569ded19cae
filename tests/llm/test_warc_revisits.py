from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.llm import warc_revisits

SCHEMA = "record_id long, url string, ts long, status int, headers map<string,string>, payload string, key int"


def solved(spark, rows):
    table = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return {r["record_id"]: r for r in warc_revisits.resolve(table).collect()}


def test_canonical_urls(spark):
    urls = {
        "HTTP://WWW.Example.com:80/a/#x": "example.com/a",
        "https://example.com/a?utm_source=f": "example.com/a",
        "https://example.com/a/?b=2&a=1&": "example.com/a?a=1&b=2",
        "example.com": "example.com",
        "": "",
    }
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    found = table.select("url", warc_revisits.canonical_url(F.col("url")).alias("key")).collect()
    assert {r["url"]: r["key"] for r in found} == urls


def test_reasons_and_merging(spark):
    full = {"ETag": '"1"', "Last-Modified": "d", "Content-Length": "9", "Server": "s", "X-A": "old"}
    rows = [
        (1, "http://a.com/x", 10, 200, full, "P1"),
        (2, "https://www.a.com/x/", 20, 304, {"etag": 'W/"1"', "content-length": "0", "x-a": "new"}, None),
        (3, "http://a.com/x", 30, 304, {"ETag": '"2"', "Last-Modified": "d"}, None),
        (4, "http://a.com/x", 31, 304, {"Last-Modified": "d", "Connection": "X-A", "X-A": "hop", "N": "1"}, None),
        (5, "http://a.com/x", 32, 304, None, None),
        (6, "http://a.com/x", 5, 304, {"ETag": '"1"'}, None),
        (7, None, 40, 304, {"ETag": '"1"'}, None),
        (8, "http://a.com/x", None, 304, {"ETag": '"1"'}, None),
        (9, "http://a.com/x", 33, 200, {"ETag": '"9"'}, "P9"),
        (10, "http://a.com/x", 33, 304, {"ETag": '"9"'}, None),
        (11, "http://a.com/x", 34, None, None, None),
        (12, "http://a.com/x", 35, 304, {"ETag": '"1"'}, None),
    ]
    found = solved(spark, rows)
    reasons = {k: r["reason"] for k, r in found.items()}
    assert reasons == {
        1: None, 2: None, 3: "changed", 4: None, 5: "no-validator", 6: "no-response", 7: "no-key",
        8: "no-key", 9: None, 10: None, 11: None, 12: "changed",
    }
    assert [found[k]["base_id"] for k in (1, 2, 3, 4, 10, 11)] == [1, 1, None, 1, 9, 11]
    assert found[2]["payload"] == "P1" and found[10]["payload"] == "P9" and found[3]["payload"] is None
    assert found[2]["headers"] == {
        "etag": 'W/"1"', "last-modified": "d", "content-length": "9", "server": "s", "x-a": "new",
    }
    assert found[4]["headers"]["x-a"] == "old" and found[4]["headers"]["n"] == "1"


def test_one_url_over_many_ranges(spark):
    rows = [
        (i, "http://hot.com/", i // 3, 200 if i % 50 == 0 else 304, {"ETag": "x"}, f"P{i}" if i % 50 == 0 else None)
        for i in range(900)
    ]
    found = solved(spark, rows)
    last = None
    for i, *_ in sorted(rows, key=lambda r: (r[2], r[3] != 200, r[0])):
        last = i if i % 50 == 0 else last
        assert found[i]["base_id"] == last


def test_empty_and_repeated_rows(spark):
    assert solved(spark, []) == {}
    row = (1, "http://a.com", 1, 200, {}, "p")
    table = spark.createDataFrame([(*row, 0), (*row, 0)], SCHEMA)
    assert warc_revisits.resolve(table).count() == 2
