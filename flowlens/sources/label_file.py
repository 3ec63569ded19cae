"""Ground-truth label files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import CLASS_DEFINITION_VERSION, FEATURE_SCHEMA_VERSION, LABEL_SOURCES
from flowlens.session import ship_by_value

ship_by_value(__name__)

ENTRY = (
    "traffic_type string, capture_id string, capture_sha256 string, note string"
)
_HEADER = "label_source string, feature_schema_version string, class_definition_version string"


class LabelFileError(ValueError):
    """The file as a whole cannot be used."""


def yaml_to_json(text: str) -> str:
    """One label file of YAML as JSON text."""
    import yaml

    return json.dumps(yaml.safe_load(text), default=str)


def _as_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [yaml_to_json(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the label file(s) at ``path`` with their position and source.

    Files are YAML unless the path ends in ``.json``. Header problems raise; a bad entry only
    becomes a rejected row later.
    """
    schema = f"{_HEADER}, labels array<struct<{ENTRY}>>"
    if path.lower().endswith(".json"):
        raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    else:
        texts = spark.read.text(path, wholetext=True).mapInArrow(_as_json, "value string")
        raw = texts.select(F.from_json("value", schema).alias("file")).select("file.*")
    headers = raw.select(
        F.coalesce("label_source", F.lit(LABEL_SOURCES[0])).alias("source"),
        "feature_schema_version",
        "class_definition_version",
    )
    expected = {
        "source": LABEL_SOURCES,
        "feature_schema_version": (FEATURE_SCHEMA_VERSION,),
        "class_definition_version": (CLASS_DEFINITION_VERSION,),
    }
    bad = [headers.where(~F.col(c).isin(*values)) for c, values in expected.items()]
    for (column, values), rows in zip(expected.items(), bad, strict=True):
        first = rows.select(column).first()
        if first is not None:
            raise LabelFileError(f"{column} {first[0]!r} is not one of {list(values)}")
    return raw.select(
        F.coalesce("label_source", F.lit(LABEL_SOURCES[0])).alias("label_source"),
        F.posexplode("labels").alias("index", "entry"),
    ).select("index", "label_source", "entry.*")
