"""Classifier: preprocessing, fitting, registry and scoring on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import (
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
    SPLIT_SEED,
)
from flowlens.functions.numeric import round_half_even, round_sql
from flowlens.operators.forest import Forest
from flowlens.session import exists

MODEL_TYPE = "random_forest"
# ---- fixed values: forest size and seed; unlimited depth is bounded by Spark at 30 ---------
TREES, MAX_DEPTH = 300, 30
#: training rows up to which Spark's forest is fitted, whose nodes are all in the driver
DRIVER_ROWS = 1000

REGISTRY = (
    "model_version string, model_type string, feature_schema_version string, "
    "dataset_version string, preprocessing_version string, training_timestamp string, "
    "random_seed int, classes array<string>, feature_names array<string>, dataset_digest string, "
    "training_data_counts map<string,bigint>, medians map<string,double>, "
    "indicators array<string>, status string, accuracy double, path string"
)


class ModelNotAvailable(LookupError):
    """No registered model fits the request."""


class FeatureSchemaMismatch(ValueError):
    """The model was trained on other features."""


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("n")).scalar()
    kinds = counts.agg(F.count("*").alias("k")).scalar()
    return counts.select("label", (whole / (kinds * F.col("n"))).alias("weight"))


def weighted(train: DataFrame) -> DataFrame:
    """``train`` with the weight of each row's class, a case of one branch a class, so no row moves.

    Classes are those of the contract, so their weights are a few rows.
    """
    branches = [F.when(F.col("label") == r["label"], F.lit(r["weight"])) for r in class_weights(train).collect()]
    return train.withColumn("weight", F.coalesce(*branches) if branches else F.lit(None).cast("double"))


def fit_medians(train: DataFrame) -> DataFrame:
    """Exact median of every feature and whether it had a gap, one row per feature.

    Values are counted first, spread by (feature, value), and the medians then read the counts.
    """
    named = [
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"))
        for name in FEATURE_NAMES
    ]
    counted = (
        train.select(F.inline(F.array(*named)))
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    known = F.col("value").isNotNull()
    return counted.groupBy("feature").agg(
        F.percentile("value", F.lit(0.5), F.when(known, F.col("n")).otherwise(F.lit(0))).alias("median"),
        F.bool_or(~known).alias("had_gap"),
    )


def impute(rows: DataFrame, medians: dict[str, float | None], indicators: list[str]) -> DataFrame:
    """Fill gaps with training medians and add a 0/1 column per feature that had gaps in training."""
    filled = {
        name: F.coalesce(F.col(name).cast("double"), F.lit(medians.get(name) or 0.0))
        for name in FEATURE_NAMES
    }
    marks = {f"{name}_missing": F.col(name).isNull().cast("double") for name in indicators}
    return rows.withColumns({**marks}).withColumns(filled)


def vector_columns(indicators: list[str]) -> list[str]:
    return [*FEATURE_NAMES, *[f"{name}_missing" for name in indicators]]


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit sample deviation as an array column ``scaled``."""
    assembled = VectorAssembler(inputCols=columns, outputCol="_assembled").transform(rows)
    scaler = StandardScaler(inputCol="_assembled", outputCol="_scaled", withMean=True).fit(assembled)
    scaled = scaler.transform(assembled).withColumn("scaled", vector_to_array("_scaled"))
    return scaled.drop("_assembled", "_scaled")


def fit_modes(train: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of every column, the smallest of equally frequent ones."""
    modes = {}
    for column in columns:
        counted = train.where(F.col(column).isNotNull()).groupBy(column).count()
        top = counted.orderBy(F.desc("count"), column).first()
        modes[column] = top[0] if top else None
    return modes


def encode_categories(
    train: DataFrame, rows: DataFrame, columns: list[str]
) -> tuple[DataFrame, PipelineModel]:
    """``rows`` with gaps filled by the training rows' modes, and indexes and one-hot vectors.

    Values are indexed by their frequency in training; unseen ones share a last index.
    """
    modes = {c: m for c, m in fit_modes(train, columns).items() if m is not None}
    fitted = Pipeline(stages=categorical_stages(columns)).fit(train.fillna(modes))
    return fitted.transform(rows.fillna(modes)), fitted


def categorical_stages(columns: list[str]) -> list:
    """Encoders for categorical features; contract 1.0 declares none. Unseen values get a slot."""
    stages: list = []
    for column in columns:
        stages.append(StringIndexer(inputCol=column, outputCol=f"{column}_index", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{column}_index", outputCol=f"{column}_vector"))
    return stages


def fit_forest(
    train: DataFrame,
    indicators: list[str],
    trees: int = TREES,
    depth: int = MAX_DEPTH,
    seed: int = SPLIT_SEED,
    categorical: tuple[str, ...] = (),
    rows: int = 0,
) -> PipelineModel:
    """Index, assemble, standardise, forest. ``train`` is imputed and carries label and weight.

    From more than ``DRIVER_ROWS`` training ``rows`` on, tasks grow the trees and keep them (``forest``).
    """
    inputs = [*vector_columns(indicators), *[f"{c}_vector" for c in categorical]]
    classifier = RandomForestClassifier(
        labelCol="label_index",
        featuresCol="features",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        cacheNodeIds=True,
    )
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            *categorical_stages(list(categorical)),
            VectorAssembler(inputCols=inputs, outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="features", withMean=True),
            Forest(trees, depth, seed) if rows > DRIVER_ROWS else classifier,
        ]
    ).fit(train)


def classes_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Class probabilities, the best class and its confidence.

    The label indexer is a training stage and is skipped here.
    """
    names = classes_of(model)
    scored = rows
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    labels = F.array(*[F.lit(name) for name in names])
    values = scored.withColumn("_p", vector_to_array("probability"))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    rounded = F.expr(f"transform(_p, p -> {round_sql('p', 6)})")
    named = values.withColumn("_max", F.array_max("_p")).select(
        *rows.columns,
        F.element_at(labels, best).alias("top_candidate"),
        round_half_even("_max", 4).alias("confidence"),
        F.col("_max").alias("raw_confidence"),
        F.map_from_arrays(labels, rounded).alias("probabilities"),
        F.map_from_arrays(labels, "_p").alias("raw_probabilities"),
    )
    return named


def register(spark: SparkSession, registry: str, row: dict) -> None:
    """Append one model to the registry table."""
    columns = [part.strip().split(" ")[0] for part in REGISTRY.split(", ")]
    spark.createDataFrame([tuple(row.get(c) for c in columns)], REGISTRY).write.mode("append").json(registry)


def registered(spark: SparkSession, registry: str) -> DataFrame:
    if not exists(spark, registry):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).json(registry)


def newest_compatible(models: DataFrame, schema_version: str = FEATURE_SCHEMA_VERSION) -> DataFrame:
    """Newest model version (training stamp, then version) of the schema; one row, maybe NULL."""
    newest = F.max_by("model_version", F.struct("training_timestamp", "model_version"))
    return models.where(F.col("feature_schema_version") == schema_version).agg(
        newest.alias("model_version")
    )


def resolve(models: DataFrame, requested: str | None = None):
    """The registry row to score with, or an error saying why there is none."""
    version = requested or newest_compatible(models).first()["model_version"]
    row = models.where(F.col("model_version") == version).first() if version else None
    if row is None:
        raise ModelNotAvailable(f"no registered model {version or 'for this feature schema'}")
    if row["feature_schema_version"] != FEATURE_SCHEMA_VERSION:
        raise FeatureSchemaMismatch(f"{version} uses feature schema {row['feature_schema_version']}")
    if tuple(row["feature_names"]) != FEATURE_NAMES:
        raise FeatureSchemaMismatch(f"{version} uses other features")
    return row


def single_version(rows: DataFrame, column: str) -> DataFrame:
    """The value if all rows agree on one, else NULL."""
    value = F.col(column)
    known = F.when(value != "", value)
    agreed = F.when(F.min(known) == F.max(known), F.max(known))
    return rows.agg(agreed.alias(column))


def model_counts(models: DataFrame) -> DataFrame:
    samples = F.aggregate(
        F.map_values("training_data_counts"), F.lit(0).cast("bigint"), lambda a, n: a + n
    )
    return models.agg(
        F.count("*").alias("registered_models"), F.sum(samples).alias("training_samples")
    )


def newest_first(models: DataFrame) -> DataFrame:
    return models.orderBy(F.col("training_timestamp").desc(), F.col("model_version").desc())


def public_metrics(models: DataFrame) -> DataFrame:
    """Metrics only of models that were evaluated; NULL means "not measured"."""
    measured = (F.col("status") == "OK") & F.col("accuracy").isNotNull()
    return models.select(
        "model_version", F.when(measured, F.col("accuracy")).alias("accuracy")
    )
