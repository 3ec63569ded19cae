"""Stored predictions: abstention, upsert, filters, history and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import LOW_CONFIDENCE, UNKNOWN_CLASS
from flowlens.functions.numeric import round_half_even
from flowlens.functions.ordering import human_id, human_number, newest, number_rows

KEY = ["flow_id", "model_version"]
#: what a stored row keeps when its flow is scored again
_KEPT = ("prediction_id", "created_at")


def abstain(rows: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    """``UNKNOWN`` below the threshold; the best candidate is kept beside it."""
    unsure = F.col(confidence) < threshold
    return (
        rows.withColumn("prediction", F.when(unsure, UNKNOWN_CLASS).otherwise(F.col("top_candidate")))
        .withColumn("abstained", unsure)
        .withColumn("min_confidence_threshold", F.lit(threshold))
    )


def upsert(existing: DataFrame, scored: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Full outer merge on (flow, model version) with ``change``: insert, update or keep.

    A scored row takes every column that the scoring gives; updated rows keep their id and creation
    stamp, and inserted ones are stamped with ``stamp`` (by default the current time).
    """
    stamp = F.current_timestamp() if stamp is None else stamp
    given = [c for c in scored.columns if c not in (*KEY, *_KEPT)]
    stored = [c for c in existing.columns if c not in KEY]
    old = existing.select(*KEY, *[F.col(c).alias(f"_old_{c}") for c in stored], F.lit(True).alias("_stored"))
    new = scored.select(*KEY, *given, F.lit(True).alias("_scored"))
    merged = old.join(new, KEY, "full_outer")
    is_scored, is_stored = F.col("_scored").isNotNull(), F.col("_stored").isNotNull()

    def current(column: str) -> Column:
        if column not in given:
            return F.col(f"_old_{column}").alias(column)
        before = F.col(f"_old_{column}") if column in stored else F.lit(None)
        return F.when(is_scored, F.col(column)).otherwise(before).alias(column)

    columns = [*given, *[c for c in stored if c not in given and c != "created_at"]]
    created = F.lit(None)
    if "created_at" in stored:
        created = F.col("_old_created_at")
        stamp = stamp.cast(existing.schema["created_at"].dataType)
    return merged.select(
        *KEY,
        *[current(c) for c in columns],
        F.when(is_stored, created).otherwise(stamp).alias("created_at"),
        F.when(is_scored & is_stored, "update").when(is_scored, "insert").otherwise("keep").alias("change"),
    )


def stale(existing: DataFrame, scored: DataFrame, analysed: DataFrame) -> DataFrame:
    """Stored predictions of the captures and model versions in ``analysed`` not scored again."""
    scope = analysed.select("capture_id", "model_version").distinct()
    return existing.join(scope, ["capture_id", "model_version"], "left_semi").join(
        scored.select(*KEY), KEY, "left_anti"
    )


def without_stale(existing: DataFrame, scored: DataFrame, analysed: DataFrame) -> DataFrame:
    """``existing`` without its stale rows."""
    gone = stale(existing, scored, analysed).select(*KEY)
    return existing.join(gone, KEY, "left_anti")


def number_predictions(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """``PRED-`` ids for new rows in (flow, model) order after the highest stored number.

    The maximum is numeric, so ids past 999999 keep counting.
    """
    highest = existing.agg(
        F.coalesce(F.max(human_number("PRED", F.col("prediction_id"))), F.lit(0)).alias("n")
    ).scalar()
    hashed = fresh.withColumn("_h", F.sha2(F.concat_ws("|", *KEY), 256))
    order = [F.col("_h"), *[F.col(c) for c in KEY]]
    numbered = number_rows(hashed, order, F.substring("_h", 1, 3), "_n")
    return numbered.withColumn("prediction_id", human_id("PRED", F.col("_n") + highest)).drop("_h", "_n")


def filtered(
    predictions: DataFrame,
    model_version: str | None = None,
    prediction: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    rows = predictions
    if model_version:
        rows = rows.where(F.col("model_version") == model_version)
    if prediction:
        rows = rows.where(F.col("prediction") == prediction.upper())
    if min_confidence is not None:
        rows = rows.where(F.col("confidence") >= min_confidence)
    return rows


def by_confidence(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(F.col("confidence").desc(), "flow_id")


def history(
    predictions: DataFrame,
    capture_id: str | None = None,
    flow_id: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest predictions across analyses; the limit is the feature."""
    rows = predictions
    if capture_id:
        rows = rows.where(F.col("capture_id") == capture_id)
    if flow_id:
        rows = rows.where(F.col("flow_id") == flow_id)
    return rows.orderBy(F.col("created_at").desc(), "prediction_id").limit(limit)


def latest(predictions: DataFrame) -> DataFrame:
    """Newest prediction of every flow."""
    return newest(predictions, ["flow_id"], [F.col("created_at").desc(), F.col("prediction_id")])


def summarise(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean confidence and class distribution per group.

    Classes are counted first, so the map is built from at most one entry per class.
    """
    classes = predictions.groupBy(*by, "prediction").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("total"),
        F.count_if(F.col("abstained")).alias("abstained"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low"),
    )
    raw = classes.groupBy(*by).agg(
        F.sum("n").alias("count"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.sum(F.when(F.col("prediction") == UNKNOWN_CLASS, F.col("n")).otherwise(0)).alias("unknown_count"),
        F.sum("abstained").alias("abstained_count"),
        F.sum("low").alias("low_confidence_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("prediction", "n")))).alias(
            "class_distribution"
        ),
    )
    return raw.select(
        *by,
        "count",
        round_half_even("mean", 4).alias("average_confidence"),
        "unknown_count",
        "abstained_count",
        "low_confidence_count",
        "class_distribution",
    )


def totals(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("prediction") == UNKNOWN_CLASS).alias("unknown"),
    )


def without_analysis(
    predictions: DataFrame, captures: DataFrame, model_version: str | None = None
) -> DataFrame:
    """Predictions left after deleting those of some captures, optionally of one model only."""
    gone = captures.select("capture_id").distinct().withColumn("_gone", F.lit(True))
    marked = predictions.join(gone, "capture_id", "left")
    doomed = F.col("_gone").isNotNull()
    if model_version:
        doomed = doomed & (F.col("model_version") == model_version)
    return marked.where(~doomed).drop("_gone")
