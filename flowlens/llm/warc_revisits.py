"""Resolution of not-modified revisits in a crawl archive.

A capture with status 304 has no payload of its own. It is joined as of its time to the latest
earlier full response (status 200) of the same canonical URL, its validators are held against the
response's, and the headers that a 304 may update are merged into the response's.

The as-of join deals captures out by ranges of (URL, time, record), so a URL with any number of
captures spans several ranges. Inside a range a running last value finds the response; between
ranges only the last response of each (URL, range) is handed on.

Defined results: a capture without URL or time is not resolved (reason ``no-key``); neither is one
without an earlier response (``no-response``), one whose ETag differs, or, without an ETag on both
sides, whose Last-Modified differs (``changed``), or one with no validator in common
(``no-validator``). Captures of one URL and time are ordered by record id, responses first; repeated
rows are answered each; null headers are no headers; an empty table gives an empty result. Further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.session import store

# ---- fixed values of HTTP: fields that a 304 must not change in a stored response -----------
UNCHANGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host and path that name a resource: no scheme, port, ``www.``, fragment or campaign fields.

    Query fields are sorted, and a slash at the end of the path is dropped.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.split(F.regexp_extract(bare, "^[^?]*[?](.*)$", 1), "&")
    fields = F.array_sort(F.filter(fields, lambda x: (x != "") & ~x.rlike("^utm_")))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.concat(host, path, query)


def _prepared(records: DataFrame) -> DataFrame:
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    names = F.transform_keys(headers, lambda k, v: F.lower(k))
    full = F.col("status") == 200
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("key"),
        "ts",
        "status",
        names.alias("headers"),
        "payload",
    )
    response = F.struct("record_id", "headers", "payload")
    return rows.withColumns(
        {"full": F.when(full, response), "rank": F.when(full, 0).otherwise(1)}
    )


def _as_of(rows: DataFrame) -> DataFrame:
    """``base``: the latest response at or before each row's place in (key, ts, rank, record)."""
    order = ["key", "ts", "rank", "record_id"]
    dealt = store(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "captures")
    inside = W.partitionBy("key", "range").orderBy(*order[1:])
    here = dealt.withColumn("base", F.last("full", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # one row for each key and range, so few even for a key that fills many ranges
    ends = dealt.where("full is not null").groupBy("key", "range").agg(
        F.max_by("full", F.struct("ts", "record_id")).alias("end")
    )
    every = dealt.select("key", "range").distinct().join(ends, ["key", "range"], "left")
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    handed = every.withColumn("handed", F.last("end", ignorenulls=True).over(before))
    handed = handed.where("handed is not null").select("key", "range", "handed")
    joined = here.join(handed, ["key", "range"], "left")
    return joined.withColumn("base", F.coalesce("base", "handed")).drop("handed", "range", "full", "rank")


def _etag(headers: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def _reason(revisit: Column, base: Column) -> Column:
    tags = _etag(revisit), _etag(base["headers"])
    dates = F.trim(revisit["last-modified"]), F.trim(base["headers"]["last-modified"])
    both_tags = tags[0].isNotNull() & tags[1].isNotNull()
    both_dates = dates[0].isNotNull() & dates[1].isNotNull()
    return (
        F.when(F.col("key").isNull() | F.col("ts").isNull(), "no-key")
        .when(base.isNull(), "no-response")
        .when(both_tags, F.when(tags[0] != tags[1], "changed"))
        .when(both_dates, F.when(dates[0] != dates[1], "changed"))
        .otherwise("no-validator")
    )


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers with those of a 304 that may replace them."""
    named = F.split(F.lower(F.coalesce(update["connection"], F.lit(""))), "[ ,]+")
    allowed = F.map_filter(
        update, lambda k, v: ~k.isin(*UNCHANGED) & ~F.array_contains(named, k) & v.isNotNull()
    )
    return F.map_zip_with(stored, allowed, lambda k, old, new: F.coalesce(new, old))


def resolve(records: DataFrame) -> DataFrame:
    """Every capture with the response it stands for.

    ``records`` has ``record_id``, ``url``, ``ts``, ``status``, ``headers`` (map) and ``payload``
    (a digest or a place in the archive). Result: ``record_id``, ``key``, ``ts``, ``status``,
    ``base_id``, ``headers``, ``payload`` and ``reason``; for a capture that is no revisit, or is
    resolved, ``reason`` is null, and a resolved revisit has its response's payload and the merged
    headers.
    """
    rows = _prepared(records)
    whole = F.col("key").isNotNull() & F.col("ts").isNotNull()
    placed = _as_of(rows.where(whole))
    rest = rows.where(~whole).withColumn("base", F.col("full")).select(*placed.columns)
    found = placed.unionByName(rest)
    revisit, base = F.col("status") == 304, F.col("base")
    found = found.withColumn("reason", F.when(revisit, _reason(F.col("headers"), base)))
    solved = F.coalesce(revisit, F.lit(False)) & F.col("reason").isNull()
    return found.select(
        "record_id",
        "key",
        "ts",
        "status",
        F.when(solved, base["record_id"]).when(~F.coalesce(revisit, F.lit(False)), F.col("record_id")).alias("base_id"),
        F.when(solved, merged_headers(base["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(solved, base["payload"]).otherwise(F.col("payload")).alias("payload"),
        "reason",
    )
