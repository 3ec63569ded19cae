from __future__ import annotations

import json

import pytest
from flowlens.contract import FEATURE_NAMES, FEATURES
from flowlens.operators import dataset as ds
from flowlens.operators import model, predictions
from flowlens.plans import scoring, training
from flowlens.session import store
from flowlens.sources import label_file
from pyspark.sql import functions as F

CLASSES = ("WEB", "VOIP", "EMAIL", "VIDEO")
COLUMNS = ", ".join(f"{name} double" for name in FEATURE_NAMES)
DDL = f"flow_id string, capture_id string, flow_key string, analysis_id string, label string, {COLUMNS}, feature_schema_version string"


def feature_values(centre: float, index: int) -> list[float | None]:
    values = []
    for f in FEATURES:
        value = centre + (index % 5) * 0.5 + (index % 3) * 0.1
        value = min(value / 100.0, 1.0) if f.maximum else value
        values.append(None if f.nullable and index % 3 == 0 else value)
    return values


def labelled(spark, captures: int = 5, flows: int = 10, classes=CLASSES):
    rows = []
    for c, name in enumerate(classes):
        for capture in range(captures):
            key = f"CAP-{c * captures + capture:06d}"
            for i in range(flows):
                rows.append((f"{key}-{i}", key, f"k{i}", f"ANL-{key}", name, *feature_values(10.0 + 20 * c, i), "1.0"))
    return ds.validate_features(spark.createDataFrame(rows, DDL))


def test_counting_reasons_parses_each_document_once(spark):
    rows = spark.createDataFrame(
        [("1.0", "not json"), ("0.9", "{}"), (None, None), ("1.0", '{"packet_count": true}')],
        "feature_schema_version string, feature_json string",
    )
    counts = ds.rejection_counts(ds.validate_feature_json(rows))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    found = {r["reason"]: r["rows"] for r in counts.collect()}
    assert found == {ds.VERSION_MISMATCH: 2, ds.NULL_VALUE: 1, ds.BOOLEAN: 1}


def test_training_rows_are_dealt_by_their_number(spark):
    few, many = (spark.range(n).coalesce(1) for n in (900, 2500))
    assert training.dealt(few, 900).rdd.getNumPartitions() == 1
    assert training.dealt(many, 2500).rdd.getNumPartitions() == 3
    assert training.dealt(many, 2500).count() == 2500


def test_typed_validation_order(spark):
    good = feature_values(10.0, 1)

    def row(i, version="1.0", **changes):
        values = [changes.get(n, v) for n, v in zip(FEATURE_NAMES, good, strict=True)]
        return (str(i), "c", "k", "a", None, *values, version)

    cases = [
        (row(0), None, None),
        (row(1, "0.9", packet_count=None), ds.VERSION_MISMATCH, None),
        (row(2, packet_count=None, byte_count=-1.0), ds.NULL_VALUE, "packet_count"),
        (row(3, byte_count=-1.0), ds.OUT_OF_RANGE, "byte_count"),
        (row(4, packet_size_std=float("nan")), ds.NOT_FINITE, "packet_size_std"),
        (row(5, packet_size_std=None), None, None),
        (row(6, direction_ratio=1.5), ds.OUT_OF_RANGE, "direction_ratio"),
        (row(7, burst_count=float("inf")), ds.NOT_FINITE, "burst_count"),
    ]
    found = ds.validate_features(spark.createDataFrame([c[0] for c in cases], DDL))
    for r in found.collect():
        _, reason, feature = cases[int(r["flow_id"])]
        assert (r["reject_reason"], r["reject_feature"]) == (reason, feature), r["flow_id"]


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 7, 10, 20, 150, 1001])
def test_split_sizes(spark, total):
    train, validation = int(total * 0.7), int(total * 0.15)
    if total >= 3:
        train, validation = max(train, 1), max(validation, 1)
        while total - train - validation < 1:
            if train >= validation:
                train -= 1
            else:
                validation -= 1
    else:
        train, validation = total, 0
    keys = spark.range(total).selectExpr("cast(id as string) as k")
    counts = {r["split"]: r["count"] for r in ds.allocate_captures(keys, "k").groupBy("split").count().collect()}
    rest = total - train - validation
    expected = {"train": train, "validation": validation, "test": rest}
    assert counts == {k: v for k, v in expected.items() if v}


def test_label_file(spark, tmp_path):
    good = {"label_source": "user_provided", "feature_schema_version": "1.0", "labels": [{"capture_id": "CAP-000001", "traffic_type": "web"}, {"traffic_type": "VOIP"}]}
    path = tmp_path / "labels.json"
    path.write_text(json.dumps(good))
    checked = ds.validate_labels(label_file.read_labels(spark, str(path))).orderBy("index").collect()
    assert [r["reject_reason"] for r in checked] == [None, ds.LABEL_NO_KEY]
    path.write_text(json.dumps({**good, "label_source": "guessed"}))
    with pytest.raises(label_file.LabelFileError):
        label_file.read_labels(spark, str(path))
    pytest.importorskip("yaml")
    assert json.loads(label_file.yaml_to_json("labels:\n  - capture_id: a\n"))["labels"] == [{"capture_id": "a"}]


def test_refusals(spark, tmp_path):
    few = training.train(labelled(spark, 5, 1), "v1", str(tmp_path), "2024-01-01")
    assert few.status == "INSUFFICIENT_DATA" and few.model_version is None
    assert few.shortfalls[0] == "labeled flows 20 < min_total_samples 40"
    assert "class WEB has 5 samples, needs 10" in few.shortfalls
    none = training.train(labelled(spark).where("label is null"), "v1", str(tmp_path), "2024-01-01")
    assert none.status == "INSUFFICIENT_LABELED_DATA"
    features = labelled(spark, 1, 2).drop("reject_reason", "reject_feature")
    assert scoring.score_features(features, str(tmp_path))[0] == "MODEL_NOT_AVAILABLE"
    assert scoring.score_features(features, str(tmp_path), enabled=False)[0] == "DISABLED"


def test_train_score_and_merge(spark, tmp_path):
    data = labelled(spark)
    result = training.train(data, "v1", str(tmp_path), "2024-01-01", trees=15, depth=6)
    assert result.status == "OK" and sum(result.split_counts.values()) == 200
    assert result.evaluation["accuracy"] == 1.0 and result.evaluation["evaluated_samples"] >= 20
    registry = model.registered(spark, f"{tmp_path}/registry")
    assert model.newest_compatible(registry).first()[0] == "v1"
    row = model.resolve(registry)
    assert list(row["classes"]) == sorted(CLASSES) and len(row["dataset_digest"]) == 64
    with pytest.raises(model.ModelNotAvailable):
        model.resolve(registry, "v9")

    features = data.drop("reject_reason", "reject_feature")
    status, scored, rejected = scoring.score_features(features, str(tmp_path))
    assert status == "OK" and rejected.count() == 0
    sample = scored.first()
    assert abs(sum(sample["probabilities"].values()) - 1.0) < 1e-4
    assert sample["top_candidate"] == max(sample["probabilities"], key=sample["probabilities"].get)
    _, unsure, _ = scoring.score_features(features, str(tmp_path), threshold=1.01)
    assert {r["prediction"] for r in unsure.collect()} == {"UNKNOWN"}

    existing = scored.where("false").selectExpr("*", "cast(null as string) as prediction_id", "cast(null as bigint) as created_at")
    captures = features.select("capture_id").distinct()
    first = scoring.merge_predictions(existing, scored, captures, "v1")
    ids = sorted(r["prediction_id"] for r in first.collect())
    assert ids[0] == "PRED-000001" and len(set(ids)) == 200
    whole = ("probabilities", "model_type", "dataset_version", "observation_status", "created_at")
    assert first.where(" or ".join(f"{c} is null" for c in whole)).count() == 0
    fewer = scored.where("flow_id not like 'CAP-000000%'")
    other = first.limit(3).withColumn("model_version", F.lit("v0"))
    stored_rows = store(first.unionByName(other).drop("change"), "stored")
    again = scoring.merge_predictions(stored_rows, fewer, captures, "v1")
    changes = {r["change"]: r["count"] for r in again.groupBy("change").count().collect()}
    assert changes == {"update": 190, "keep": 3}


def test_training_is_repeatable(spark, tmp_path):
    data = labelled(spark)
    runs = [training.train(data, f"v{i}", str(tmp_path), "2024-01-01", trees=5, depth=4) for i in (1, 2)]
    assert runs[0].evaluation == runs[1].evaluation
    assert runs[0].split_counts == runs[1].split_counts


def test_stale_and_numbers_past_a_million(spark):
    old = spark.createDataFrame([("f", "m", "PRED-1000000")], "flow_id string, model_version string, prediction_id string")
    new = spark.createDataFrame([("g", "m")], "flow_id string, model_version string")
    assert predictions.number_predictions(new, old).first()["prediction_id"] == "PRED-1000001"


def test_dataset_moves_features_by_their_flow_only(spark):
    values = feature_values(10.0, 1)
    numbers = [f"cast({v} as double) as {n}" for n, v in zip(FEATURE_NAMES, values, strict=True)]
    version = "if(id = 8, '0.9', '1.0') as feature_schema_version"
    features = spark.range(9).selectExpr("concat('f', id) as flow_id", *numbers, version)
    flows = spark.createDataFrame(
        [("f0", "k0", "a1"), ("f1", "k1", "a1"), ("f2", "k2", "a2"), ("f3", "k3", "a3"), ("f4", "k4", None),
         ("f5", "k5", "a9"), ("f6", "k6", "a4"), ("f6", "k6b", "a2"), ("f8", "k8", "a1")],
        "flow_id string, flow_key string, analysis_id string",
    )
    analyses = spark.createDataFrame(
        [("a1", "c1"), ("a2", "c2"), ("a3", "c3"), ("a4", None)], "analysis_id string, capture_id string"
    )
    # c2 is stored with two content hashes, c3 is not stored
    captures = spark.createDataFrame(
        [("c1", "h1"), ("c2", "h2"), ("c2", "h2b")], "capture_id string, capture_sha256 string"
    )
    keys = spark.createDataFrame(
        [("c1", "WEB"), ("h1", "VOIP"), ("h2", "EMAIL"), ("h2b", "VIDEO"), ("c3", "ICMP")],
        "capture_key string, traffic_type string",
    )
    rows = ds.build_dataset(features, flows, analyses, captures, keys)
    assert rows.columns[:3] == ["capture_id", "analysis_id", "flow_id"]
    assert rows.columns[-5:] == ["flow_key", "capture_sha256", "reject_reason", "reject_feature", "label"]
    found = sorted((r["flow_id"], r["flow_key"], r["label"], r["reject_reason"]) for r in rows.na.fill("").collect())
    two = [(x, k, label, "") for x, k in (("f2", "k2"), ("f6", "k6b")) for label in ("EMAIL", "EMAIL", "VIDEO", "VIDEO")]
    assert found == sorted(
        [("f0", "k0", "WEB", ""), ("f1", "k1", "WEB", ""), *two, ("f3", "k3", "ICMP", ds.ORPHAN),
         ("f4", "k4", "", ds.ORPHAN), ("f5", "k5", "", ds.ORPHAN), ("f6", "k6", "", ds.ORPHAN),
         ("f7", "", "", ds.ORPHAN), ("f8", "k8", "WEB", ds.VERSION_MISMATCH)]
    )
    assert ds.build_dataset(features, flows, analyses, captures, keys, max_rows=3).count() == 3

    # the features are read and judged once
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 9") == 1
