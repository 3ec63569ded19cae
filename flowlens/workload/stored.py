"""Derived tables written once per session.

Rules, scoring and views work on stored analysis tables; deriving those from ``events`` again
for every query would measure the derivation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.session import store

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """``build(spark, folder)`` as a table in the shared folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = store(build(spark, folder), name)
    return _WRITTEN[key]
