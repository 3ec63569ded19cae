"""Classifier metrics over scored rows.

Input: ``label``, ``predicted`` and, for confidence metrics, ``confidence`` and ``p_true`` (the
probability given to the true class). Everything is one aggregation by class pair or bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.contract import MIN_CONFIDENCE
from flowlens.functions.numeric import round_half_even

# ---- fixed values: reliability buckets and their midpoints --------------------------------
BUCKETS = (("0.00-0.40", 0.2), ("0.40-0.60", 0.5), ("0.60-0.80", 0.7), ("0.80-1.00", 0.9))
_TINY = 2.220446049250313e-16  # smallest probability the log loss sees


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class seen as label or prediction; 0 where undefined."""
    matrix = confusion_matrix(rows)
    sides = [
        matrix.select(
            F.col(column).alias("class_name"),
            F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
            F.col("n").alias(column),
        )
        for column in ("label", "predicted")
    ]
    counts = sides[0].withColumn("predicted", F.lit(0).cast("bigint")).unionByName(
        sides[1].withColumn("label", F.lit(0).cast("bigint")).withColumn("hits", F.lit(0).cast("bigint"))
    )
    return counts.groupBy("class_name").agg(
        F.sum("hits").cast("bigint").alias("hits"),
        F.sum("label").cast("bigint").alias("support"),
        F.sum("predicted").cast("bigint").alias("predicted_rows"),
    ).selectExpr(
        "class_name",
        "hits",
        "support",
        "predicted_rows",
        "coalesce(hits / nullif(predicted_rows, 0), 0e0) as raw_precision",
        "coalesce(hits / nullif(support, 0), 0e0) as raw_recall",
        "coalesce(2e0 * hits / nullif(support + predicted_rows, 0), 0e0) as raw_f1",
    )


def class_report(rows: DataFrame) -> DataFrame:
    return per_class(rows).select(
        "class_name",
        round_half_even("raw_precision", 4).alias("precision"),
        round_half_even("raw_recall", 4).alias("recall"),
        round_half_even("raw_f1", 4).alias("f1"),
        "support",
    )


def summary(rows: DataFrame) -> DataFrame:
    """Accuracy and the macro and weighted averages over classes."""
    totals = per_class(rows).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("raw_precision").alias("precision_macro"),
        F.avg("raw_recall").alias("recall_macro"),
        F.avg("raw_f1").alias("f1_macro"),
        (F.sum(F.col("raw_f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("evaluated_samples"),
    )
    names = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")
    return totals.select(
        *[round_half_even(name, 4).alias(name) for name in names], "evaluated_samples"
    )


def log_loss(rows: DataFrame) -> DataFrame:
    """Mean negative log probability of the true class, NULL without rows or probabilities."""
    clipped = F.greatest(F.lit(_TINY), F.least(F.col("p_true"), F.lit(1.0 - _TINY)))
    mean = rows.agg(F.avg(-F.log(clipped)).alias("loss"))
    return mean.select(round_half_even("loss", 4).alias("log_loss"))


def reliability(rows: DataFrame) -> DataFrame:
    """Rows and accuracy per confidence bucket; empty buckets stay with a NULL accuracy."""
    bucket = """case when confidence < 0.4D then '0.00-0.40' when confidence < 0.6D then '0.40-0.60'
        when confidence < 0.8D then '0.60-0.80' else '0.80-1.00' end as bucket"""
    counts = (
        rows.selectExpr(bucket, "cast(label = predicted as int) as hit")
        .groupBy("bucket")
        .agg(F.count("*").alias("rows"), F.sum("hit").alias("hits"))
    )
    values = ", ".join(f"('{name}', {middle}D)" for name, middle in BUCKETS)
    frame = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS buckets(bucket, midpoint)")
    return frame.join(counts, "bucket", "left").select(
        "bucket",
        "midpoint",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("count"),
        round_half_even("hits / rows", 4).alias("accuracy"),
    )


def calibration_error(buckets: DataFrame) -> DataFrame:
    """Count-weighted distance between accuracy and bucket midpoint; NULL without rows."""
    distance = F.col("count") * F.abs(F.col("accuracy") - F.col("midpoint"))
    raw = buckets.agg((F.sum(distance) / F.nullif(F.sum("count"), F.lit(0))).alias("error"))
    return raw.select(round_half_even("error", 4).alias("expected_calibration_error"))


def confidence_summary(rows: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Mean confidence, abstained rows and their share at the threshold in force."""
    raw = rows.agg(
        F.avg("confidence").alias("mean"),
        F.count_if(F.col("confidence") < threshold).alias("abstained_count"),
        F.count("*").alias("n"),
    )
    return raw.select(
        round_half_even("mean", 4).alias("mean_predicted_confidence"),
        "abstained_count",
        round_half_even("abstained_count / n", 4).alias("abstention_rate"),
    )


def evaluation(rows: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """All headline metrics as one row."""
    parts = [
        summary(rows),
        log_loss(rows),
        calibration_error(reliability(rows)),
        confidence_summary(rows, threshold),
    ]
    keyed = [part.withColumn("_one", F.lit(1)) for part in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
