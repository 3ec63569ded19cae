"""Dataset to registered model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import (
    DATASET_VERSION,
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
    MIN_CONFIDENCE,
    MIN_SAMPLES_FOR_METRICS,
    PREPROCESSING_VERSION,
    SPLIT_SEED,
)
from flowlens.operators import dataset as ds
from flowlens.operators import metrics, model
from flowlens.session import store

#: training rows a task takes before the forest is fitted by more of them
TASK_ROWS = 1000


@dataclass
class TrainingResult:
    status: str
    shortfalls: list[str] = field(default_factory=list)
    model_version: str | None = None
    split_counts: dict[str, int] = field(default_factory=dict)
    evaluation: dict | None = None
    validation_agreement: int | None = None
    path: str | None = None


def training_frame(train: DataFrame) -> tuple[DataFrame, dict, list[str]]:
    """Imputed, weighted training rows with the medians and gap indicators learnt from them."""
    learnt = {row["feature"]: row for row in model.fit_medians(train).collect()}  # 27 rows
    medians = {name: learnt[name]["median"] for name in FEATURE_NAMES}
    indicators = [name for name in FEATURE_NAMES if learnt[name]["had_gap"]]
    return model.impute(model.weighted(train), medians, indicators), medians, indicators


def dealt(train: DataFrame, rows: int) -> DataFrame:
    """``train`` over as many tasks as its rows are worth, one for each core at most.

    Its bytes are few, so that it is one split, but every node of every tree is counted over its rows, and
    the nodes' splits are found by as many tasks as there are parts.
    """
    parts = min(-(-rows // TASK_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    return train.repartition(parts) if parts > 1 else train


def scored_for_metrics(rows: DataFrame, fitted: PipelineModel) -> DataFrame:
    """Label, prediction, confidence and the probability of the true class."""
    scored = model.score(rows, fitted)
    return scored.select(
        "label",
        F.col("top_candidate").alias("predicted"),
        F.col("raw_confidence").alias("confidence"),
        F.coalesce(F.try_element_at("raw_probabilities", "label"), F.lit(0.0)).alias("p_true"),
    )


def train(
    dataset: DataFrame,
    model_version: str,
    model_dir: str,
    timestamp: str,
    split_key: str = "capture_id",
    trees: int = model.TREES,
    depth: int = model.MAX_DEPTH,
    threshold: float = MIN_CONFIDENCE,
    seed: int = SPLIT_SEED,
) -> TrainingResult:
    """Fit, evaluate and register a model, or refuse with every shortfall and fit nothing."""
    spark = dataset.sparkSession
    accepted = store(ds.samples(dataset), "samples")
    allocation = ds.allocate_captures(accepted, split_key, seed)
    rows = store(ds.split_rows(accepted, allocation, split_key), "split_samples")
    gate = ds.sufficiency(dataset, rows).first()
    if gate["status"] != "OK":
        return TrainingResult(gate["status"], list(gate["shortfalls"]))
    leaked = ds.leaked_captures(rows, split_key).first()
    if leaked is not None:
        raise ValueError(f"capture {leaked[split_key]} is in several splits")

    parts = {name: rows.where(F.col("split") == name) for name in ("train", "validation", "test")}
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    ready, medians, indicators = training_frame(parts["train"])
    ready = dealt(store(ready, "training"), counts["train"])
    fitted = model.fit_forest(ready, indicators, trees, depth, seed, rows=counts["train"])

    def judged(name: str) -> DataFrame:
        return scored_for_metrics(model.impute(parts[name], medians, indicators), fitted)

    evaluation, agreement, status = None, None, "INSUFFICIENT_DATA"
    if counts.get("test", 0) >= MIN_SAMPLES_FOR_METRICS:
        evaluation = metrics.evaluation(store(judged("test"), "judged"), threshold).first().asDict()
        agreement = judged("validation").where("label = predicted").count()
        status = "OK"
    path = f"{model_dir}/models/{model_version}"
    fitted.write().overwrite().save(path)
    digest = ds.dataset_digest(accepted, ["capture_id", "flow_key", "label", *FEATURE_NAMES]).first()[0]
    model.register(
        spark,
        f"{model_dir}/registry",
        {
            "model_version": model_version,
            "model_type": model.MODEL_TYPE,
            "feature_schema_version": FEATURE_SCHEMA_VERSION,
            "dataset_version": DATASET_VERSION,
            "preprocessing_version": PREPROCESSING_VERSION,
            "training_timestamp": timestamp,
            "random_seed": seed,
            "classes": model.classes_of(fitted),
            "feature_names": list(FEATURE_NAMES),
            "dataset_digest": digest,
            "training_data_counts": counts,
            "medians": medians,
            "indicators": indicators,
            "status": status,
            "accuracy": evaluation["accuracy"] if evaluation else None,
            "path": path,
        },
    )
    return TrainingResult("OK", [], model_version, counts, evaluation, agreement, path)


def dataset_report(dataset: DataFrame) -> DataFrame:
    """Counters of the dataset without fitting anything."""
    return ds.dataset_counters(dataset)


def load(spark: SparkSession, model_dir: str, requested: str | None = None):
    """Registry row and fitted pipeline of the requested or newest compatible model."""
    row = model.resolve(model.registered(spark, f"{model_dir}/registry"), requested)
    return row, PipelineModel.load(row["path"])
