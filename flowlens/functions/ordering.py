"""Global numbering and newest-row selection without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, order: list[Column], bucket: Column, output: str, start: int | Column = 1
) -> DataFrame:
    """Consecutive numbers over the whole table in ``order``.

    ``bucket`` must not decrease along ``order`` (a prefix of the first ordering key, a day, ...).
    Buckets are numbered on their own; only their row counts meet in one window, so no task holds
    more than one bucket of rows.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        tagged.withColumn("_in_bucket", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(output, (F.col("_before") + F.col("_in_bucket") - 1 + first).cast("bigint"))
        .drop("_bucket", "_in_bucket", "_before")
    )


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. The rank filter is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def human_id(prefix: str, number: Column) -> Column:
    """``PREFIX-000001``; more digits where the number needs them."""
    text = number.cast("string")
    padded = F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    return F.concat(F.lit(prefix + "-"), padded)


def human_number(prefix: str, value: Column) -> Column:
    """Numeric suffix of a human id; NULL for anything else, so a numeric maximum can be taken."""
    digits = F.regexp_extract(value, f"^{prefix}-([0-9]+)$", 1)
    return F.nullif(digits, F.lit("")).cast("bigint")
