"""Lookups, slices, pages and roll-ups over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.ordering import newest

# ---- fixed values: human id prefixes, page bounds -----------------------------------------
HUMAN_PREFIXES = {"captures": "CAP-", "analyses": "ANL-", "jobs": "JOB-", "findings": "SEC-"}
MIN_PAGE, MAX_PAGE, DEFAULT_PAGE = 1, 500, 50


def by_key(table: DataFrame, key: str, prefix: str, human_column: str, id_column: str) -> DataFrame:
    """Rows addressed by a human id (``CAP-000001``) or by their row id."""
    return table.where(F.col(human_column if key.startswith(prefix) else id_column) == key)


def resolve_keys(
    keys: DataFrame, table: DataFrame, prefix: str, human_column: str, id_column: str
) -> DataFrame:
    """Many keys at once: each ``key`` matched on the human id or the row id, by its prefix."""
    is_human = F.startswith(F.col("key"), F.lit(prefix))
    human = keys.where(is_human).join(table, F.col("key") == F.col(human_column))
    plain = keys.where(~is_human).join(table, F.col("key") == F.col(id_column))
    return human.unionByName(plain)


def slice_of(table: DataFrame, capture_id: str) -> DataFrame:
    """Rows of one capture; prunes partitions on a table stored by capture."""
    return table.where(F.col("capture_id") == capture_id)


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin("queued", "running")).alias("pending_jobs"))


def search_captures(captures: DataFrame, text: str) -> DataFrame:
    """Case-insensitive part of the id or file name, or start of the content hash."""
    wanted = text.lower()
    return captures.where(
        F.lower(F.coalesce("capture_id", F.lit(""))).contains(wanted)
        | F.lower("original_filename").contains(wanted)
        | F.col("sha256").startswith(wanted)
    )


def latest_job(captures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Captures with their newest job."""
    order = [F.col("created_at").desc(), F.col("job_id")]
    return captures.join(newest(jobs, ["capture_id"], order), "capture_id", "left")


def newest_first(table: DataFrame, stamp: str, tie: str) -> DataFrame:
    return table.orderBy(F.col(stamp).desc(), F.col(tie))


def page(table: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """One page; offset and limit are the feature and stay a top-k in the plan."""
    if number < 1 or not MIN_PAGE <= size <= MAX_PAGE:
        raise ValueError("page starts at 1, page size is 1 to 500")
    return table.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(table: DataFrame, size: int) -> DataFrame:
    """Row and page counts; an empty table still has one page."""
    pages = F.greatest(F.ceil(F.count("*") / F.lit(size)), F.lit(1))
    return table.agg(F.count("*").alias("total"), pages.cast("bigint").alias("total_pages"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [
        table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, table in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def messages_with_proposals(messages: DataFrame, proposals: DataFrame) -> DataFrame:
    """Messages with their proposals nested; a message holds at most 16, its parser's limit."""
    item = F.struct(
        *[c for c in proposals.columns if c not in ("ike_message_id", "capture_id", "packet_id")]
    )
    ordered = F.struct("proposal_number", "protocol_name", "encryption", item.alias("item"))
    nested = proposals.groupBy("ike_message_id").agg(F.collect_list(ordered).alias("found"))
    sorted_items = F.array_sort(
        "found",
        lambda a, b: F.when(_rank(a) < _rank(b), -1).when(_rank(a) > _rank(b), 1).otherwise(0),
    )
    items = F.transform(sorted_items, lambda f: f["item"])
    empty = F.array().cast(proposals.select(F.array(item).alias("x")).schema["x"].dataType)
    return messages.join(nested, "ike_message_id", "left").select(
        *messages.columns, F.coalesce(items, empty).alias("proposals")
    )


def _rank(entry: Column) -> Column:
    return F.struct(entry["proposal_number"], entry["protocol_name"], entry["encryption"])


def entries_by_value(counts: Column) -> Column:
    """Entries of a map, largest value first, key as tie break."""
    ranked = F.transform(
        F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("r"), e["key"].alias("key"), e["value"].alias("value"))
    )
    return F.transform(F.array_sort(ranked), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
