"""Checks of the dataset, metrics, registry and prediction operators.

Feature rows, labels and predictions are read from the supplied tables: flows of the packet log
where real features matter, ``lineitem``, ``orders`` and ``documents`` where volume or faults do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import FEATURE_NAMES, FEATURES, TRAFFIC_CLASSES
from flowlens.operators import dataset as ds
from flowlens.operators import features, flows, metrics, model, predictions, views
from flowlens.plans import assessment, scoring, training
from flowlens.session import shared_folder
from flowlens.workload.base import micros_sql, packets, read
from flowlens.workload.stored import stored
from flowlens.workload.traffic import BURST, FEATURES_SQL, r


# ---- validation ----------------------------------------------------------------------------
def _json_text(text: str) -> str:
    """Feature documents of line items, about half of them broken in some way."""
    values = []
    for i, f in enumerate(FEATURES):
        plain = f"cast((l_linenumber + {i}) % 2 as {text})" if f.maximum else f"cast(l_linenumber + {i} as {text})"
        arms = {
            "packet_count": "when l_orderkey % 29 = 0 then 'null' when l_orderkey % 31 = 0 then 'true'",
            "byte_count": "when l_orderkey % 37 = 0 then '\"7\"' when l_orderkey % 41 = 0 then '-1'",
            "packet_size_std": "when l_orderkey % 3 = 0 then 'null' when l_orderkey % 43 = 0 then 'NaN'",
            "direction_ratio": "when l_orderkey % 47 = 0 then '1.5'",
            "burst_count": "when l_orderkey % 53 = 0 then '[1]' when l_orderkey % 59 = 0 then '-Infinity'",
        }.get(f.name)
        value = f"case {arms} else {plain} end" if arms else plain
        values.append(f"'\"{f.name}\":', {value}")
    return "concat('{', " + ", ',', ".join(values) + ", '}')"


def _json_rows(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "case when l_orderkey % 61 = 0 then '0.9' else '1.0' end as feature_schema_version",
        f"case when l_orderkey % 67 = 0 then 'not json' else {_json_text('string')} end as feature_json",
    )


def _validated_json(spark: SparkSession, folder: str) -> DataFrame:
    return ds.validate_feature_json(_json_rows(spark, folder)).select(
        "l_orderkey", "l_linenumber", "reject_reason", "reject_feature"
    )


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    return ds.rejection_counts(ds.validate_feature_json(_json_rows(spark, folder)))


def _label_columns(text: str) -> str:
    sha = "sha256(cast(doc_id as varchar))" if text == "varchar" else "sha2(cast(doc_id as string), 256)"
    return f"""doc_id as index,
      case when doc_id % 11 = 0 then '' when doc_id % 13 = 0 then 'p2p' when doc_id % 17 = 0 then 'unknown'
        when quality = 1 then ' web ' when toxic = 1 then 'Voip' else 'email' end as traffic_type,
      case when doc_id % 5 = 0 or doc_id % 7 = 0 then null
        else concat('CAP-', lpad(cast(doc_id % 60 as {text}), 6, '0')) end as capture_id,
      case when doc_id % 7 = 0 and doc_id % 2 = 0 then null when doc_id % 19 = 0 then 'abc'
        when doc_id % 3 = 0 then {sha} end as capture_sha256"""


def label_entries(spark: SparkSession, folder: str) -> DataFrame:
    from flowlens.workload.base import _split

    columns = [c.strip() for c in _split(_label_columns("string"))]
    return read(spark, folder, "labels").selectExpr(*columns)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return ds.validate_labels(label_entries(spark, folder)).select("index", "traffic_type", "reject_reason")


# ---- dataset -------------------------------------------------------------------------------
def _feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """Features from one stored packet table and one flow table, which a plan of all would hold many times."""
    log = stored(spark, folder, "packets", packets)
    sides = stored(spark, folder, "flows", lambda s, d: flows.build_flows(log))
    longest = sides.agg(F.max("packet_count")).first()[0] or 0
    return features.flow_features(log, sides, BURST, longest=longest)


def _real_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "features", _feature_table)
    return rows.withColumn("flow_id", F.concat_ws(">", "capture_id", "flow_key"))


def dataset_table(spark: SparkSession, folder: str) -> DataFrame:
    """Flow features joined with flows, analyses, captures and labels; some links are missing."""
    features = _real_features(spark, folder).drop("capture_id", "flow_key", "flow_pair", "packet_size_histogram")
    features = features.withColumn(
        "feature_schema_version", F.expr("if(packet_count % 13 = 12, '0.9', feature_schema_version)")
    )
    flows = _real_features(spark, folder).where("byte_count % 19 <> 3").selectExpr(
        "flow_id", "flow_key", "concat('ANL-', substr(capture_id, 5)) as analysis_id"
    )
    captures = _real_features(spark, folder).select("capture_id").distinct()
    analyses = captures.selectExpr("concat('ANL-', substr(capture_id, 5)) as analysis_id", "capture_id")
    hashed = captures.where("capture_id <> 'CAP-000007'").selectExpr(
        "capture_id", "sha2(capture_id, 256) as capture_sha256"
    )
    return ds.build_dataset(features, flows, analyses, hashed, _keys(spark, folder))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the log's captures: classes of customers' nations, by id or by hash."""
    rows = read(spark, folder, "customer").selectExpr(
        "c_custkey as index",
        "case c_custkey % 3 when 0 then 'WEB' when 1 then 'VOIP' else 'EMAIL' end as traffic_type",
        "concat('CAP-', lpad(cast(c_custkey % 14 + 1 as string), 6, '0')) as cap",
    )
    entries = rows.where("cap not in ('CAP-000002', 'CAP-000005')").selectExpr(
        "index", "traffic_type", "case when index % 2 = 0 then cap end as capture_id",
        "case when index % 2 = 1 then sha2(cap, 256) end as capture_sha256",
    )
    return ds.label_keys(ds.validate_labels(entries))


def stored_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "dataset", dataset_table)


_DATASET_SHOWN = ["flow_id", "capture_id", "reject_reason", "reject_feature", "label"]


def _dataset_rows(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_table(spark, folder).select(*_DATASET_SHOWN)


def _provenance(spark: SparkSession, folder: str) -> DataFrame:
    return stored_dataset(spark, folder).groupBy("capture_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("reject_reason") == ds.ORPHAN).alias("orphans")
    )


def _scoring_input(spark: SparkSession, folder: str) -> DataFrame:
    features = _real_features(spark, folder).select("flow_id", "packet_count")
    flows = _real_features(spark, folder).where("byte_count % 19 <> 3").select("flow_id", "flow_key")
    return scoring.scoring_input(features, flows)


def _allocation(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders stand in for captures."""
    return ds.allocate_captures(read(spark, folder, "orders"), "o_custkey")


def _split_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders")
    allocated = ds.split_rows(rows, ds.allocate_captures(rows, "o_custkey"), "o_custkey")
    return allocated.groupBy("split").agg(F.count("*").alias("rows"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    """A split by order instead of by customer leaks customers."""
    rows = read(spark, folder, "orders").selectExpr("o_custkey", "if(o_orderkey % 4 = 0, 'test', 'train') as split")
    return ds.leaked_captures(rows, "o_custkey")


def _gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_dataset(spark, folder)
    accepted = ds.samples(rows)
    split = ds.split_rows(accepted, ds.allocate_captures(accepted, "capture_id"), "capture_id")
    return ds.sufficiency(rows, split).withColumn("shortfalls", F.array_join("shortfalls", "; "))


def _digest(spark: SparkSession, folder: str) -> DataFrame:
    return ds.dataset_digest(
        read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"]
    )


def _medians(spark: SparkSession, folder: str) -> DataFrame:
    return model.fit_medians(_real_features(spark, folder))


def _imputed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _real_features(spark, folder).withColumn(
        "interarrival_std", F.expr("if(packet_count % 5 = 0, null, interarrival_std)")
    )
    ready, _, _ = training.training_frame(rows.withColumn("label", F.col("capture_id")))
    return ready.select("flow_id", "interarrival_std", "interarrival_std_missing", F.round("weight", 9).alias("weight"))


def _standardised(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("packet_count", "packet_size_mean")
    rows = model.standardise(_real_features(spark, folder), list(columns))
    return rows.select(
        "flow_id", *[F.round(F.col("scaled")[i], 9).alias(c) for i, c in enumerate(columns)]
    )


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    """Order states with gaps; one state is not seen in training."""
    rows = read(spark, folder, "orders").selectExpr(
        "o_orderkey", "case when o_custkey % 7 = 0 then null else o_orderstatus end as state"
    )
    seen = rows.where("o_orderkey % 2 = 0 and (state is null or state <> 'P')")
    encoded, _ = model.encode_categories(seen, rows, ["state"])
    return encoded.select("o_orderkey", "state", "state_index")


def _classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Train on the labelled captures, register, load and score every flow."""
    rows = stored_dataset(spark, folder)
    target = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    trained = training.train(rows, "v1", target, "2024-01-01T00:00:00")
    if trained.status != "OK":
        raise ValueError(f"{trained.status}: {trained.shortfalls}")
    scored = scoring.score_features(_real_features(spark, folder), target)[1]
    return scored.drop("probabilities")


# ---- metrics -------------------------------------------------------------------------------
def _scores(spark: SparkSession, folder: str) -> DataFrame:
    names = ", ".join(f"'{c}'" for c in TRAFFIC_CLASSES[:6])
    return read(spark, folder, "lineitem").selectExpr(
        f"array({names})[cast(l_orderkey % 6 as int)] as label",
        f"array({names})[cast((l_orderkey + case when l_partkey % 4 = 0 then 1 else 0 end) % 6 as int)] as predicted",
        "(l_partkey * 37 + l_linenumber) % 100 / 100.0e0 as confidence",
        "(1 + (l_suppkey * 13 + l_linenumber) % 99) / 100.0e0 as p_true",
    )


# ---- predictions ---------------------------------------------------------------------------
_SCORE = "(o_custkey * 37 + o_orderkey) % 100"
_PREDICTION = f"""
  concat('F-', cast(cast(floor(o_orderkey / 3.0e0) as bigint) as {{S}})) as flow_id,
  concat('m', cast(o_orderkey % 3 as {{S}})) as model_version,
  concat('CAP-', lpad(cast(o_custkey % 20 as {{S}}), 6, '0')) as capture_id,
  case when {_SCORE} < 60 then 'UNKNOWN' else {{classes}} end as prediction,
  {{classes}} as top_candidate, ({_SCORE}) / 100.0e0 as confidence,
  6e-1 as min_confidence_threshold, {_SCORE} < 60 as abstained,
  concat('PRED-', lpad(cast(o_orderkey + 1 as {{S}}), 6, '0')) as prediction_id,
  o_orderkey * 10 as created_at"""
_CLASS_SPARK = "array({})[cast(o_custkey % 6 as int)]".format(", ".join(f"'{c}'" for c in TRAFFIC_CLASSES[:6]))
_CLASS_DUCK = "(case o_custkey % 6 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(TRAFFIC_CLASSES[:6])) + " end)"


def prediction_table(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as stored predictions: three models per flow."""
    from flowlens.workload.base import _split

    text = _PREDICTION.format(S="string", classes=_CLASS_SPARK)
    rows = read(spark, folder, "orders").selectExpr(*[c.strip() for c in _split(text)])
    return rows.withColumn("probabilities", F.create_map("top_candidate", "confidence"))


def _rescored(spark: SparkSession, folder: str) -> DataFrame:
    """A second run over half the flows and one new model."""
    rows = prediction_table(spark, folder).where("created_at % 20 = 0")
    fresh = rows.withColumn(
        "model_version", F.expr("if(model_version = 'm1', 'm9', model_version)")
    ).withColumn("confidence", F.lit(0.9))
    fresh = fresh.withColumn("probabilities", F.create_map("top_candidate", "confidence"))
    return fresh.withColumn("model_type", F.lit("forest")).drop("prediction_id", "created_at")


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Whole rows, inserted, updated and kept."""
    stamp = F.lit(777).cast("bigint")
    merged = predictions.upsert(prediction_table(spark, folder), _rescored(spark, folder), stamp)
    top = F.col("probabilities")[F.col("top_candidate")]
    return merged.withColumn("p_top", top).drop("probabilities")


def _stale(spark: SparkSession, folder: str) -> DataFrame:
    """Ten captures scored again with two of the models; half of their flows are left."""
    stored_rows = prediction_table(spark, folder)
    analysed = stored_rows.where("capture_id < 'CAP-000010' and model_version <> 'm1'")
    scored = analysed.where("created_at % 20 = 0")
    return predictions.stale(stored_rows, scored, analysed).groupBy("capture_id", "model_version").agg(
        F.count("*").alias("rows")
    )


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    fresh = prediction_table(spark, folder).where("model_version = 'm1'").drop("prediction_id")
    return predictions.number_predictions(fresh, prediction_table(spark, folder)).select(
        "flow_id", "model_version", "prediction_id"
    )


def _summary_of(by: list[str]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = predictions.summarise(prediction_table(spark, folder), by)
        shown = F.transform(
            views.entries_by_value(F.col("class_distribution")),
            lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
        )
        return rows.withColumn("class_distribution", F.array_join(shown, ","))

    return query


def _abstained(spark: SparkSession, folder: str) -> DataFrame:
    rows = prediction_table(spark, folder).select("flow_id", "model_version", "top_candidate", "confidence")
    return predictions.abstain(rows, 0.75)


# ---- registry ------------------------------------------------------------------------------
def model_table(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as registered models: brand is the schema version, size the training stamp."""
    return read(spark, folder, "part").selectExpr(
        "concat('v', lpad(cast(p_partkey as string), 6, '0')) as model_version",
        "if(p_partkey % 3 = 0, '0.9', '1.0') as feature_schema_version",
        "concat('2024-01-', lpad(cast(p_size as string), 2, '0')) as training_timestamp",
        "map('train', p_partkey, 'test', cast(p_size as bigint)) as training_data_counts",
        "case when p_partkey % 4 = 0 then 'INSUFFICIENT_DATA' else 'OK' end as status",
        "case when p_partkey % 5 <> 0 then p_size / 50.0e0 end as accuracy",
        "p_brand as analyzer_version",
        "case when p_size > 0 then '2.1' end as parser_version",
    )


def _single(spark: SparkSession, folder: str) -> DataFrame:
    """One column all models agree on and one they do not."""
    rows = model_table(spark, folder)
    named = [
        model.single_version(rows, c).select(F.lit(c).alias("column_name"), F.col(c).alias("value"))
        for c in ("parser_version", "analyzer_version")
    ]
    return named[0].unionByName(named[1])


# ---- views ---------------------------------------------------------------------------------
def _captures(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").selectExpr(
        "concat('CAP-', lpad(cast(c_custkey as string), 6, '0')) as capture_id",
        "cast(c_custkey as string) as id",
        "concat(c_name, '.pcap') as original_filename",
        "sha2(cast(c_custkey as string), 256) as sha256",
    )


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(
        "concat('JOB-', lpad(cast(o_orderkey as string), 6, '0')) as job_id",
        "concat('CAP-', lpad(cast(o_custkey as string), 6, '0')) as capture_id",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status",
        f"{micros_sql('o_orderdate')} as created_at",
    )


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    keys = read(spark, folder, "orders").selectExpr(
        "if(o_orderkey % 2 = 0, concat('CAP-', lpad(cast(o_custkey as string), 6, '0')),"
        " cast(o_custkey as string)) as key"
    ).distinct()
    found = views.resolve_keys(keys, _captures(spark, folder), "CAP-", "capture_id", "id")
    return found.select("key", "capture_id")


def _latest_job(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.latest_job(_captures(spark, folder).select("capture_id"), _jobs(spark, folder))
    return rows.select("capture_id", "job_id", "status")


def _dashboard(spark: SparkSession, folder: str) -> DataFrame:
    return views.table_counts(
        {
            "captures": _captures(spark, folder),
            "analysis_jobs": _jobs(spark, folder),
            "models": model_table(spark, folder),
            "predictions": prediction_table(spark, folder),
            "labels": read(spark, folder, "labels"),
        }
    )


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").selectExpr("upper(lang) as label")
    return ds.declared_classes(rows)


def _distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").selectExpr(
        "case lang when 'en' then 'WEB' when 'de' then 'VOIP' when 'fr' then 'EMAIL' else upper(lang) end as label"
    )
    return ds.class_distribution(rows)


QUERIES = {
    "F16_feature_validation": _validated_json,
    "A31_rejection_counts": _reasons,
    "F17_label_validation": _labels,
    "J5_label_keys": lambda s, d: ds.label_keys(ds.validate_labels(label_entries(s, d))),
    "M1_J4_dataset_builder": _dataset_rows,
    "J4_provenance_chain": _provenance,
    "J6_scoring_input": _scoring_input,
    "M2_dataset_audit": lambda s, d: ds.audit_rows(stored_dataset(s, d)),
    "A33_M16_dataset_counters": lambda s, d: training.dataset_report(stored_dataset(s, d)),
    "L9_dataset_row_cap": lambda s, d: ds.capped(stored_dataset(s, d), 100).select("flow_id"),
    "A32_class_distribution": _distribution,
    "U3_class_union": _classes,
    "A34_dataset_digest": _digest,
    "M3_capture_split": _allocation,
    "M4_split_rows": _split_counts,
    "U4_split_leakage": _leaks,
    "M5_sufficiency_gate": _gate,
    "M6_feature_medians": _medians,
    "M6_imputed_rows": _imputed,
    "M7_standardised_features": _standardised,
    "M8_categorical_encode": _categories,
    "M9_M11_M13_M14_train_and_score": _classifier,
    "A35_confusion_matrix": lambda s, d: metrics.confusion_matrix(_scores(s, d)),
    "A36_class_report": lambda s, d: metrics.class_report(_scores(s, d)),
    "A36_summary": lambda s, d: metrics.summary(_scores(s, d)),
    "A37_log_loss": lambda s, d: metrics.log_loss(_scores(s, d)),
    "A38_reliability": lambda s, d: metrics.reliability(_scores(s, d)),
    "A39_calibration_error": lambda s, d: metrics.calibration_error(metrics.reliability(_scores(s, d))),
    "A40_confidence_summary": lambda s, d: metrics.confidence_summary(_scores(s, d)),
    "M10_evaluation": lambda s, d: metrics.evaluation(_scores(s, d)),
    "F18_abstention": _abstained,
    "F11_prediction_filters": lambda s, d: predictions.filtered(
        prediction_table(s, d), "m2", "voip", 0.7
    ).select("flow_id", "confidence"),
    "F12_L5_history": lambda s, d: predictions.history(prediction_table(s, d), capture_id="CAP-000003").select(
        "prediction_id", "created_at"
    ),
    "L4_by_confidence": lambda s, d: predictions.by_confidence(prediction_table(s, d)).select(
        "confidence", "flow_id", "model_version"
    ),
    "W6_latest_prediction": lambda s, d: predictions.latest(prediction_table(s, d)).select(
        "flow_id", "prediction_id"
    ),
    "J11_prediction_upsert": _upserted,
    "J12_stale_predictions": _stale,
    "W8_prediction_numbers": _numbered,
    "A41_L8_prediction_summary": _summary_of(["capture_id"]),
    "A42_prediction_totals": lambda s, d: predictions.totals(prediction_table(s, d)),
    "M15_delete_predictions": lambda s, d: predictions.without_analysis(
        prediction_table(s, d), read(s, d, "nation").selectExpr("concat('CAP-', lpad(n_regionkey, 6, '0')) as capture_id"), "m1"
    ).groupBy("capture_id").agg(F.count("*").alias("rows")),
    "W7_newest_compatible_model": lambda s, d: model.newest_compatible(model_table(s, d)),
    "M12_model_lookup": lambda s, d: model_table(s, d).join(
        model.newest_compatible(model_table(s, d)), "model_version", "left_semi"
    ).select("model_version", "training_timestamp"),
    "A43_single_version": _single,
    "A44_model_counts": lambda s, d: model.model_counts(model_table(s, d)),
    "L10_models_newest_first": lambda s, d: model.newest_first(model_table(s, d)).select(
        "model_version", "training_timestamp"
    ),
    "M17_public_metrics": lambda s, d: model.public_metrics(model_table(s, d)),
    "F9_J14_key_lookup": _resolved,
    "F13_pending_jobs": lambda s, d: views.pending_jobs(_jobs(s, d)),
    "F14_capture_search": lambda s, d: views.search_captures(_captures(s, d), "CUSTOMER#00000004").select(
        "capture_id"
    ),
    "F15_assessable_gate": lambda s, d: assessment.assessable(
        _jobs(s, d).drop("status"), _jobs(s, d).select("capture_id", "status")
    ).groupBy("capture_id").agg(F.count("*").alias("analyses")),
    "J13_latest_job": _latest_job,
    "A30_dashboard_counts": _dashboard,
    "L2_page": lambda s, d: views.page(
        _jobs(s, d), 3, 50, [F.col("created_at").desc(), F.col("job_id")]
    ).select("job_id", "created_at"),
    "L2_page_totals": lambda s, d: views.page_totals(_jobs(s, d), 50),
}

# ---- DuckDB side ---------------------------------------------------------------------------
_JSON_REASON = """case when l_orderkey % 61 = 0 then 'feature_schema_version_mismatch'
  when l_orderkey % 67 = 0 or l_orderkey % 29 = 0 then 'null_on_non_nullable'
  when l_orderkey % 31 = 0 then 'bool_not_numeric' when l_orderkey % 37 = 0 then 'wrong_type'
  when l_orderkey % 41 = 0 then 'out_of_range'
  when l_orderkey % 3 <> 0 and l_orderkey % 43 = 0 then 'not_finite'
  when l_orderkey % 47 = 0 then 'out_of_range' when l_orderkey % 53 = 0 then 'wrong_type'
  when l_orderkey % 59 = 0 then 'not_finite' end"""
_JSON_FEATURE = """case when l_orderkey % 61 = 0 then null
  when l_orderkey % 67 = 0 or l_orderkey % 29 = 0 or l_orderkey % 31 = 0 then 'packet_count'
  when l_orderkey % 37 = 0 or l_orderkey % 41 = 0 then 'byte_count'
  when l_orderkey % 3 <> 0 and l_orderkey % 43 = 0 then 'packet_size_std'
  when l_orderkey % 47 = 0 then 'direction_ratio'
  when l_orderkey % 53 = 0 or l_orderkey % 59 = 0 then 'burst_count' end"""

_LABELS_SQL = f"""with e as (select {_label_columns('varchar')} from labels),
v as (select "index", upper(trim(traffic_type)) as traffic_type, capture_id, capture_sha256 from e),
c as (select *, case when traffic_type = '' then 'missing traffic_type'
    when traffic_type not in ('VOIP', 'MESSAGING', 'EMAIL', 'WEB', 'VIDEO', 'ICMP', 'UNKNOWN')
      then 'unknown class for class_definition'
    when traffic_type = 'UNKNOWN' then 'UNKNOWN is the abstention class, not a training target'
    when capture_id is null and capture_sha256 is null
      then 'neither capture_id nor capture_sha256 provided'
    when capture_sha256 is not null and not regexp_full_match(capture_sha256, '[0-9a-fA-F]{{64}}')
      then 'capture_sha256 is not a 64-char hex digest' end as reject_reason from v)"""

DATASET_SQL = FEATURES_SQL + """,
ft as (
  select concat(capture_id, '>', flow_key) as flow_id, capture_id as cap_id, flow_key as key, packet_count,
    byte_count, interarrival_std, case when packet_count % 13 = 12 then '0.9' else '1.0' end as version from feat),
lab as (
  select concat('CAP-', lpad(cast(c_custkey % 14 + 1 as varchar), 6, '0')) as lcap, c_custkey % 2 = 0 as by_id,
    arg_max(case c_custkey % 3 when 0 then 'WEB' when 1 then 'VOIP' else 'EMAIL' end, c_custkey) as label
  from customer group by 1, 2),
lk as (select * from lab where lcap not in ('CAP-000002', 'CAP-000005')),
joined as (
  select flow_id, packet_count, byte_count, case when byte_count % 19 <> 3 then cap_id end as capture_id,
    case when byte_count % 19 <> 3 then key end as flow_key,
    byte_count % 19 = 3 or cap_id = 'CAP-000007' as orphan, version, cap_id from ft),
dset as (
  select j.*, case when orphan then 'orphan_flow_feature' when version <> '1.0'
      then 'feature_schema_version_mismatch' end as reject_reason,
    coalesce(a.label, b.label) as label
  from joined j left join lk a on a.lcap = j.capture_id and a.by_id
  left join lk b on b.lcap = j.capture_id and not b.by_id and j.capture_id <> 'CAP-000007'),
samp as (select * from dset where reject_reason is null and label is not null)"""


def _split_sql(source: str, key: str) -> str:
    return f"""
  select {key}, case when n < 3 or rn <= tr then 'train' when rn <= tr + va then 'validation' else 'test' end as split
  from (select *, case when n - greatest(floor(n * 0.7), 1) - greatest(floor(n * 0.15), 1) < 1
        then greatest(floor(n * 0.7), 1) - 1 else greatest(floor(n * 0.7), 1) end as tr,
      greatest(floor(n * 0.15), 1) as va
    from (select {key}, count(*) over () as n, row_number() over (
        order by sha256(concat('42|', {key})), {key}) as rn
      from (select distinct {key} from {source})))"""


_FEATURE_UNION = " union all ".join(
    f"select '{name}' as feature, cast({name} as double) as value from feat" for name in FEATURE_NAMES
)
_CLASS_LIST = ", ".join(f"'{c}'" for c in TRAFFIC_CLASSES[:6])
_SCORES_SQL = f"""with sc as (select [{_CLASS_LIST}][1 + l_orderkey % 6] as label,
  [{_CLASS_LIST}][1 + (l_orderkey + case when l_partkey % 4 = 0 then 1 else 0 end) % 6] as predicted,
  (l_partkey * 37 + l_linenumber) % 100 / 100.0e0 as confidence,
  (1 + (l_suppkey * 13 + l_linenumber) % 99) / 100.0e0 as p_true from lineitem),
pc as (select class_name, count(*) filter (label = class_name and predicted = class_name) as hits,
    count(*) filter (label = class_name) as support, count(*) filter (predicted = class_name) as pr
  from sc, (values ('VOIP'), ('MESSAGING'), ('EMAIL'), ('WEB'), ('VIDEO'), ('ICMP')) c(class_name) group by 1),
raw as (select class_name, hits, support, pr, coalesce(hits / nullif(pr, 0), 0) as p,
    coalesce(hits / nullif(support, 0), 0) as rc, coalesce(2e0 * hits / nullif(support + pr, 0), 0) as f from pc),
bk as (select bucket, midpoint, count(label) as "count", sum(case when label = predicted then 1e0 else 0 end) /
    nullif(count(label), 0) as acc
  from (values ('0.00-0.40', 0.2e0, 0e0, 0.4e0), ('0.40-0.60', 0.5e0, 0.4e0, 0.6e0),
    ('0.60-0.80', 0.7e0, 0.6e0, 0.8e0), ('0.80-1.00', 0.9e0, 0.8e0, 2e0)) b(bucket, midpoint, lo, hi)
  left join sc on confidence >= lo and confidence < hi group by 1, 2),
rel as (select bucket, midpoint, "count", {r('acc', 4)} as accuracy from bk),
sm as (select sum(hits) / sum(support) as a, avg(p) as b, avg(rc) as c, avg(f) as d,
    sum(f * support) / sum(support) as e, cast(sum(support) as bigint) as n from raw),
ll as (select avg(-ln(p_true)) as x from sc),
ce as (select sum("count" * abs(accuracy - midpoint)) / sum("count") as x from rel),
cs as (select avg(confidence) as x, count(*) filter (confidence < 0.6) as n, count(*) as whole from sc)"""
_SUMMARY_COLUMNS = ", ".join(
    f"{r(c, 4)} as {name}"
    for c, name in zip(
        "abcde", ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"), strict=True
    )
)
_CONFIDENCE_COLUMNS = (
    f"{r('cs.x', 4)} as mean_predicted_confidence, cs.n as abstained_count,"
    f" {r('cs.n / cs.whole', 4)} as abstention_rate"
)

_PRED_SQL = f"with pred as (select {_PREDICTION.format(S='varchar', classes=_CLASS_DUCK)} from orders)"
_MODELS_SQL = """with mo as (
  select concat('v', lpad(cast(p_partkey as varchar), 6, '0')) as model_version,
    case when p_partkey % 3 = 0 then '0.9' else '1.0' end as feature_schema_version,
    concat('2024-01-', lpad(cast(p_size as varchar), 2, '0')) as training_timestamp,
    p_partkey + p_size as samples, case when p_partkey % 4 = 0 then 'INSUFFICIENT_DATA' else 'OK' end as status,
    case when p_partkey % 5 <> 0 then p_size / 50.0e0 end as accuracy, p_brand from part)"""
_JOBS_SQL = """with jobs as (
  select concat('JOB-', lpad(cast(o_orderkey as varchar), 6, '0')) as job_id,
    concat('CAP-', lpad(cast(o_custkey as varchar), 6, '0')) as capture_id,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status,
    epoch_us(o_orderdate) as created_at from orders)"""
_TWO_LEVEL = """
lv0 as (select sha256({text}) as h from {source}),
lv1 as (select concat(b, sha256(string_agg(h, '' order by h))) as h
  from (select substr(h, 1, 4) as b, h from lv0) group by b),
lv2 as (select concat(b, sha256(string_agg(h, '' order by h))) as h
  from (select substr(h, 1, 2) as b, h from lv1) group by b)
select sha256(string_agg(h, '' order by h)) as dataset_digest from lv2"""

ORACLES = {
    "F16_feature_validation": f"select l_orderkey, l_linenumber, {_JSON_REASON} as reject_reason,"
    f" {_JSON_FEATURE} as reject_feature from lineitem",
    "A31_rejection_counts": f"select {_JSON_REASON} as reason, count(*) as rows from lineitem"
    f" where {_JSON_REASON} is not null group by 1 order by 1",
    "F17_label_validation": _LABELS_SQL + ' select "index", traffic_type, reject_reason from c',
    "J5_label_keys": _LABELS_SQL
    + """ select key as capture_key, arg_max(traffic_type, "index" * 2 + pos) as traffic_type from (
      select "index", traffic_type, capture_id as key, 0 as pos from c where reject_reason is null
      union all select "index", traffic_type, capture_sha256, 1 from c where reject_reason is null)
      where key is not null group by 1""",
    "M1_J4_dataset_builder": DATASET_SQL
    + """ select flow_id, capture_id, reject_reason, null as reject_feature, label from dset""",
    "J4_provenance_chain": DATASET_SQL
    + " select capture_id, count(*) as rows, count(*) filter (orphan) as orphans from dset group by 1",
    "J6_scoring_input": DATASET_SQL
    + " select flow_id, packet_count, key as flow_key from ft where byte_count % 19 <> 3",
    "M2_dataset_audit": DATASET_SQL
    + """ select capture_id, concat('ANL-', substr(capture_id, 5)) as analysis_id, flow_key, label,
      '1.0' as feature_schema_version from samp""",
    "A33_M16_dataset_counters": DATASET_SQL
    + """ select count(*) as total_rows,
      count(*) filter (reject_reason is null and label is not null) as labeled_rows,
      count(*) filter (reject_reason is null and label is null) as unlabeled_rows,
      count(reject_reason) as rejected_rows,
      count(distinct capture_id) filter (reject_reason is distinct from 'orphan_flow_feature') as capture_count,
      count(distinct capture_id) filter (reject_reason is null and label is not null) as labeled_capture_count
      from dset""",
    "M8_categorical_encode": """
      with rows as (select o_orderkey, case when o_custkey % 7 = 0 then null else o_orderstatus end as state
        from orders),
      seen as (select state, count(*) as n from rows where o_orderkey % 2 = 0 and state <> 'P' group by 1),
      gaps as (select count(*) as n from rows where o_orderkey % 2 = 0 and state is null),
      filled as (select state, n + case when row_number() over (order by n desc, state) = 1
        then (select n from gaps) else 0 end as n from seen),
      codes as (select state, row_number() over (order by n desc, state) - 1 as code from filled),
      whole as (select o_orderkey, coalesce(state, (select state from codes where code = 0)) as state from rows)
      select o_orderkey, w.state, cast(coalesce(code, (select count(*) from codes)) as double) as state_index
      from whole w left join codes using (state)""",
    "L9_dataset_row_cap": DATASET_SQL + " select flow_id from dset order by 1 limit 100",
    "A32_class_distribution": f"""with d as (select case lang when 'en' then 'WEB' when 'de' then 'VOIP' when 'fr'
        then 'EMAIL' else upper(lang) end as label from documents),
      n as (select c.class_name, count(label) as n from (select unnest([{_CLASS_LIST}, 'UNKNOWN']) as class_name
        union select label from d) c left join d on d.label = c.class_name group by 1),
      s as (select class_name, n, n / (select count(*) from d) * 100.0e0 as share from n)
      select class_name, n as count, {r('share', 2)} as percentage from s""",
    "U3_class_union": f"select unnest([{_CLASS_LIST}, 'UNKNOWN']) as class_name union select upper(lang) from documents",
    "A34_dataset_digest": "with "
    + _TWO_LEVEL.format(
        text="concat_ws('|', l_orderkey, l_linenumber, l_returnflag, l_partkey)", source="lineitem"
    ).lstrip(),
    "M3_capture_split": _split_sql("orders", "o_custkey"),
    "M4_split_rows": f"select split, count(*) as rows from orders join ({_split_sql('orders', 'o_custkey')})"
    " using (o_custkey) group by 1",
    "U4_split_leakage": "select o_custkey, count(distinct o_orderkey % 4 = 0) as splits from orders group by 1"
    " having count(distinct o_orderkey % 4 = 0) > 1",
    "M5_sufficiency_gate": DATASET_SQL
    + f""", al as ({_split_sql('samp', 'capture_id')}),
      cc as (select label, count(*) as n from samp group by 1 having count(*) < 10),
      st as (select (select count(*) from samp) as labeled_rows,
        (select count(distinct capture_id) from samp) as caps,
        (select count(distinct split) from samp join al using (capture_id) where split <> 'train') as held,
        coalesce((select string_agg(concat('class ', label, ' has ', n, ' samples, needs 10'), '; ' order by label) from cc), '') as small),
      tx as (select labeled_rows, concat_ws('; ',
        case when labeled_rows < 40 then concat('labeled flows ', labeled_rows, ' < min_total_samples 40') end,
        nullif(small, ''), case when caps < 1 then concat('labeled captures ', caps, ' < min_captures_per_split 1') end,
        case when held <> 2 then 'capture-level split produced an empty validation or test set' end) as shortfalls from st)
      select labeled_rows, case when labeled_rows = 0 then 'INSUFFICIENT_LABELED_DATA' when shortfalls <> ''
        then 'INSUFFICIENT_DATA' else 'OK' end as status, shortfalls from tx""",
    "M6_feature_medians": FEATURES_SQL
    + f" select feature, quantile_cont(value, 0.5) as median, bool_or(value is null) as had_gap"
    f" from ({_FEATURE_UNION}) group by 1",
    "M6_imputed_rows": FEATURES_SQL
    + """, gf as (select * replace (case when packet_count % 5 <> 0 then interarrival_std end as interarrival_std) from feat),
      med as (select median(interarrival_std) as m, count(*) as whole, count(distinct capture_id) as k from gf),
      cw as (select capture_id, count(*) as n from feat group by 1)
      select concat(capture_id, '>', flow_key) as flow_id, coalesce(interarrival_std, m) as interarrival_std,
      case when interarrival_std is null then 1e0 else 0e0 end as interarrival_std_missing,
      round(whole / (k * n), 9) as weight from gf join cw using (capture_id), med""",
    "M7_standardised_features": FEATURES_SQL
    + """, st as (select avg(packet_count) as a, stddev_samp(packet_count) as b, avg(packet_size_mean) as c,
        stddev_samp(packet_size_mean) as d from feat)
      select concat(capture_id, '>', flow_key) as flow_id, round((packet_count - a) / b, 9) as packet_count,
      round((packet_size_mean - c) / d, 9) as packet_size_mean from feat, st""",
    "A35_confusion_matrix": _SCORES_SQL + " select label, predicted, count(*) as n from sc group by 1, 2",
    "A36_class_report": _SCORES_SQL
    + f" select class_name, {r('p', 4)} as precision, {r('rc', 4)} as recall, {r('f', 4)} as f1, support from raw",
    "A36_summary": _SCORES_SQL + f" select {_SUMMARY_COLUMNS}, n as evaluated_samples from sm",
    "A37_log_loss": _SCORES_SQL + f" select {r('x', 4)} as log_loss from ll",
    "A38_reliability": _SCORES_SQL + " select * from rel",
    "A39_calibration_error": _SCORES_SQL + f" select {r('x', 4)} as expected_calibration_error from ce",
    "A40_confidence_summary": _SCORES_SQL + f" select {_CONFIDENCE_COLUMNS} from cs",
    "M10_evaluation": _SCORES_SQL
    + f" select {_SUMMARY_COLUMNS}, sm.n as evaluated_samples, {r('ll.x', 4)} as log_loss,"
    f" {r('ce.x', 4)} as expected_calibration_error, {_CONFIDENCE_COLUMNS} from sm, ll, ce, cs",
    "F18_abstention": _PRED_SQL
    + """ select flow_id, model_version, top_candidate, confidence, case when confidence < 0.75 then 'UNKNOWN'
      else top_candidate end as prediction, confidence < 0.75 as abstained, 0.75e0 as min_confidence_threshold
      from pred""",
    "F11_prediction_filters": _PRED_SQL
    + " select flow_id, confidence from pred where model_version = 'm2' and prediction = 'VOIP' and confidence >= 0.7",
    "F12_L5_history": _PRED_SQL
    + " select prediction_id, created_at from pred where capture_id = 'CAP-000003'"
    " order by created_at desc, prediction_id limit 50",
    "L4_by_confidence": _PRED_SQL
    + " select confidence, flow_id, model_version from pred order by confidence desc, flow_id",
    "W6_latest_prediction": _PRED_SQL
    + " select flow_id, arg_max(prediction_id, created_at) as prediction_id from pred group by 1",
    "J11_prediction_upsert": _PRED_SQL
    + """, nw as (select * replace (0.9e0 as confidence,
        case when model_version = 'm1' then 'm9' else model_version end as model_version)
        from pred where created_at % 20 = 0)
      select flow_id, model_version, coalesce(n.capture_id, p.capture_id) as capture_id,
        coalesce(n.prediction, p.prediction) as prediction,
        coalesce(n.top_candidate, p.top_candidate) as top_candidate,
        coalesce(n.confidence, p.confidence) as confidence, coalesce(n.confidence, p.confidence) as p_top,
        0.6e0 as min_confidence_threshold, coalesce(n.abstained, p.abstained) as abstained,
        case when n.flow_id is not null then 'forest' end as model_type, p.prediction_id,
        case when p.flow_id is null then 777 else p.created_at end as created_at,
        case when n.flow_id is null then 'keep' when p.flow_id is null then 'insert' else 'update' end as change
      from pred p full join nw n using (flow_id, model_version)""",
    "J12_stale_predictions": _PRED_SQL
    + """ select capture_id, model_version, count(*) as rows from pred
      where capture_id < 'CAP-000010' and model_version <> 'm1' and created_at % 20 <> 0 group by 1, 2""",
    "W8_prediction_numbers": _PRED_SQL
    + """, mx as (select max(cast(substr(prediction_id, 6) as bigint)) as top from pred),
      nn as (select flow_id, model_version, top + row_number() over (order by
        sha256(concat(flow_id, '|', model_version)), flow_id, model_version) as n from pred, mx
        where model_version = 'm1')
      select flow_id, model_version, concat('PRED-', lpad(cast(n as varchar), cast(greatest(6, length(cast(n as varchar))) as int), '0'))
        as prediction_id from nn""",
    "A41_L8_prediction_summary": _PRED_SQL
    + f""", cl as (select capture_id, prediction, count(*) as n from pred group by 1, 2),
      su as (select capture_id, count(*) as c, avg(confidence) as mean, count(*) filter (prediction = 'UNKNOWN') as u,
        count(*) filter (abstained) as ab, count(*) filter (confidence < 0.75) as low from pred group by 1),
      di as (select capture_id, string_agg(concat(prediction, '=', n), ',' order by n desc, prediction) as t from cl group by 1)
      select capture_id, c as count, {r('mean', 4)} as average_confidence, u as unknown_count, ab as abstained_count,
        low as low_confidence_count, t as class_distribution from su join di using (capture_id)""",
    "A42_prediction_totals": _PRED_SQL
    + " select count(*) as total, count(*) filter (prediction = 'UNKNOWN') as unknown from pred",
    "M15_delete_predictions": _PRED_SQL
    + """ select capture_id, count(*) as rows from pred where not (model_version = 'm1' and capture_id in (
      select concat('CAP-', lpad(cast(n_regionkey as varchar), 6, '0')) from nation)) group by 1""",
    "W7_newest_compatible_model": _MODELS_SQL
    + """ select model_version from mo where feature_schema_version = '1.0'
      order by training_timestamp desc, model_version desc limit 1""",
    "M12_model_lookup": _MODELS_SQL
    + """ select model_version, training_timestamp from mo where feature_schema_version = '1.0'
      order by training_timestamp desc, model_version desc limit 1""",
    "A43_single_version": _MODELS_SQL
    + """ select 'parser_version' as column_name, '2.1' as value union all select 'analyzer_version',
      case when count(distinct p_brand) = 1 then max(p_brand) end from mo""",
    "A44_model_counts": _MODELS_SQL
    + " select count(*) as registered_models, cast(sum(samples) as bigint) as training_samples from mo",
    "L10_models_newest_first": _MODELS_SQL
    + " select model_version, training_timestamp from mo order by 2 desc, 1 desc",
    "M17_public_metrics": _MODELS_SQL
    + " select model_version, case when status = 'OK' then accuracy end as accuracy from mo",
    "F9_J14_key_lookup": """select distinct case when o_orderkey % 2 = 0
        then concat('CAP-', lpad(cast(o_custkey as varchar), 6, '0')) else cast(o_custkey as varchar) end as key,
      concat('CAP-', lpad(cast(o_custkey as varchar), 6, '0')) as capture_id from orders
      where o_custkey in (select c_custkey from customer)""",
    "F13_pending_jobs": _JOBS_SQL + " select count(*) filter (status in ('queued', 'running')) as pending_jobs from jobs",
    "F14_capture_search": """select concat('CAP-', lpad(cast(c_custkey as varchar), 6, '0')) as capture_id from customer
      where contains(lower(concat(c_name, '.pcap')), 'customer#00000004')""",
    "F15_assessable_gate": _JOBS_SQL
    + """ select capture_id, count(*) as analyses from jobs
      where capture_id in (select capture_id from jobs where status = 'completed') group by 1""",
    "J13_latest_job": _JOBS_SQL
    + """, rk as (select *, row_number() over (partition by capture_id order by created_at desc, job_id) as rn from jobs)
      select concat('CAP-', lpad(cast(c_custkey as varchar), 6, '0')) as capture_id, job_id, status from customer
      left join rk on rk.capture_id = concat('CAP-', lpad(cast(c_custkey as varchar), 6, '0')) and rn = 1""",
    "A30_dashboard_counts": """select 'captures' as table_name, count(*) as rows from customer union all
      select 'analysis_jobs', count(*) from orders union all select 'models', count(*) from part union all
      select 'predictions', count(*) from orders union all select 'labels', count(*) from labels""",
    "L2_page": _JOBS_SQL + " select job_id, created_at from jobs order by 2 desc, 1 limit 50 offset 100",
    "L2_page_totals": "select count(*) as total, cast(greatest(ceil(count(*) / 50), 1) as bigint) as total_pages from orders",
}
