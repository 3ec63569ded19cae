"""Feature rows to stored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import MIN_CONFIDENCE
from flowlens.operators import dataset as ds
from flowlens.operators import model, predictions
from flowlens.plans.training import load


def score_features(
    features: DataFrame,
    model_dir: str,
    requested: str | None = None,
    threshold: float = MIN_CONFIDENCE,
    enabled: bool = True,
) -> tuple[str, DataFrame | None, DataFrame | None]:
    """Status, predictions and rejected rows.

    ``features`` carry flow_id and capture_id. Statuses: DISABLED, MODEL_NOT_AVAILABLE,
    INSUFFICIENT_DATA (nothing valid to score), OK.
    """
    if not enabled:
        return "DISABLED", None, None
    checked = ds.validate_features(features)
    rejected = checked.where("reject_reason is not null")
    try:
        row, fitted = load(features.sparkSession, model_dir, requested)
    except (model.ModelNotAvailable, model.FeatureSchemaMismatch):
        return "MODEL_NOT_AVAILABLE", None, rejected
    valid = checked.where("reject_reason is null")
    if valid.isEmpty():
        return "INSUFFICIENT_DATA", None, rejected
    ready = model.impute(valid, dict(row["medians"]), list(row["indicators"]))
    scored = predictions.abstain(model.score(ready, fitted), threshold, "raw_confidence")
    return "OK", scored.select(
        "flow_id",
        "capture_id",
        F.lit(row["model_version"]).alias("model_version"),
        F.lit(row["model_type"]).alias("model_type"),
        F.lit(row["dataset_version"]).alias("dataset_version"),
        F.lit(row["feature_schema_version"]).alias("feature_schema_version"),
        "prediction",
        "top_candidate",
        "confidence",
        "min_confidence_threshold",
        "abstained",
        "probabilities",
        F.lit("model_predicted").alias("observation_status"),
    ), rejected


def scoring_input(features: DataFrame, flows: DataFrame) -> DataFrame:
    """Features of flows that are stored, with the flow's key and capture."""
    known = flows.select("flow_id", *[c for c in ("flow_key", "capture_id") if c in flows.columns])
    return features.select("flow_id", *[c for c in features.columns if c not in known.columns]).join(
        known, "flow_id"
    )


def merge_predictions(
    existing: DataFrame,
    scored: DataFrame,
    captures: DataFrame,
    model_version: str,
    stamp: Column | None = None,
) -> DataFrame:
    """Stored predictions after a run over ``captures`` with one model.

    Scored rows are updated or inserted with new ids; of the captures' other rows of that model,
    those not scored again are dropped. Everything else stays.
    """
    analysed = captures.select("capture_id", F.lit(model_version).alias("model_version"))
    kept = predictions.without_stale(existing, scored, analysed)
    merged = predictions.upsert(kept, scored, stamp)
    inserted = merged.where("change = 'insert'")
    numbered = predictions.number_predictions(inserted.drop("prediction_id"), existing)
    return merged.where("change <> 'insert'").unionByName(numbered)
