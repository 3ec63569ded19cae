from __future__ import annotations

import random

import pytest
import shipping
from flowlens.operators import forest, model
from flowlens.operators.forest import Forest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

WEIGHTS = {0.0: 1.0, 1.0: 0.5, 2.0: 2.0}


def rows_of(spark, n: int, values: int = 20, features: int = 6):
    """Noisy rows of three classes; the last feature is constant."""
    draw = random.Random(n)
    rows = []
    for i in range(n):
        label = float(draw.randrange(3))
        x = [float(draw.randrange(values)) + 3 * label * (j < 3) for j in range(features - 1)]
        rows.append((i, [*x, 1.0], label, WEIGHTS[label]))
    frame = spark.createDataFrame(rows, "id int, x array<double>, label_index double, weight double")
    return frame.withColumn("features", array_to_vector("x")).drop("x")


def told(fitted, rows) -> dict[int, list[float]]:
    scored = fitted.transform(rows).select("id", vector_to_array("probability").alias("p"))
    return {r["id"]: list(r["p"]) for r in scored.collect()}


@pytest.mark.parametrize("values", [20, 500])
def test_a_tree_of_all_rows_and_features_is_that_of_spark(spark, values, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK", 100)
    train, other = rows_of(spark, 700, values), rows_of(spark, 300, values)
    plain = RandomForestClassifier(
        labelCol="label_index", weightCol="weight", numTrees=1, maxDepth=30, bootstrap=False, featureSubsetStrategy="all"
    ).fit(train)
    own = Forest(1, 30, 7, tried=6, bootstrap=False).fit(train)
    expected = told(plain, other)
    assert told(own, other) == {i: pytest.approx(p) for i, p in expected.items()}


def test_forest_does_not_depend_on_partitions(spark):
    train, other = rows_of(spark, 400), rows_of(spark, 150)
    first = told(Forest(23, 30, 7).fit(train.coalesce(1)), other)
    again = told(Forest(23, 30, 7).fit(train.repartition(5, F.rand(3))), other.union(other).repartition(3))
    assert first == again and len(first) == 150
    assert first != told(Forest(23, 30, 8).fit(train), other)


def test_forest_votes_as_spark_does(spark):
    train, other = rows_of(spark, 600), rows_of(spark, 300)
    plain = told(RandomForestClassifier(labelCol="label_index", weightCol="weight", numTrees=200, maxDepth=30, seed=7).fit(train), other)
    own = told(Forest(200, 30, 7).fit(train), other)
    apart = [abs(a - b) for i in plain for a, b in zip(plain[i], own[i], strict=True)]
    assert sum(apart) / len(apart) < 0.03
    assert sum(p.index(max(p)) == own[i].index(max(own[i])) for i, p in plain.items()) > 270


def fit(spark, rows: int, monkeypatch):
    """Labelled rows and the forest fitted to them by the operator."""
    names = [f"f{i}" for i in range(6)]
    label = F.element_at(F.array(*[F.lit(c) for c in ("EMAIL", "VOIP", "WEB")]), F.col("label_index").cast("int") + 1)
    values = [vector_to_array("features")[i].alias(n) for i, n in enumerate(names)]
    wide = rows_of(spark, rows).select("id", "weight", label.alias("label"), *values)
    monkeypatch.setattr(model, "vector_columns", lambda _: names)
    return wide, model.fit_forest(wide, [], 12, 30, 7, rows=rows)


def test_many_training_rows_leave_no_tree_in_the_driver(spark, tmp_path, monkeypatch):
    functions = shipping.record(monkeypatch)
    wide, fitted = fit(spark, model.DRIVER_ROWS + 1, monkeypatch)
    assert not hasattr(fitted.stages[-1], "_java_obj")
    fitted.write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    assert loaded.stages[-1].getNumTrees == 12 and loaded.stages[-1].getMaxDepth() == 30
    before, after = (
        {r["id"]: r["raw_probabilities"] for r in model.score(wide, m).collect()} for m in (fitted, loaded)
    )
    assert before == after and len(before) == model.DRIVER_ROWS + 1
    assert len(functions) >= 4
    shipping.load_elsewhere(functions, tmp_path)


def test_few_training_rows_keep_the_forest_of_spark(spark, monkeypatch):
    _, fitted = fit(spark, 60, monkeypatch)
    assert isinstance(fitted.stages[-1], RandomForestClassificationModel)
