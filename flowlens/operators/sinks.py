"""Table writes, exports and cascading deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import exists, remove, store


def write_tables(tables: dict[str, DataFrame], folder: str, captures: DataFrame | None = None) -> None:
    """One Parquet table per name, partitioned by capture where it has one.

    Only the partitions of the new data are replaced. Of the ``captures`` analysed, those that have
    no row in a table lose the partition that an earlier run may have left there. Rows are
    rebalanced by capture first, so a capture's rows make few files, and a large one several.
    """
    for name, table in tables.items():
        path = f"{folder}/{name}"
        if "capture_id" not in table.columns:
            table.write.mode("overwrite").parquet(path)
            continue
        if captures is not None:
            absent = captures.select("capture_id").join(
                table.select("capture_id").distinct(), "capture_id", "left_anti"
            )
            delete_partitions(table.sparkSession, path, absent)
        writer = table.hint("rebalance", "capture_id").write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("capture_id")
        writer.parquet(path)


def delete_partitions(spark: SparkSession, path: str, captures: DataFrame) -> None:
    """Remove the capture partitions of a stored table from storage."""
    if not exists(spark, path):
        return
    held = spark.read.schema("capture_id string").parquet(path).distinct()
    gone = held.join(captures.select("capture_id"), "capture_id", "left_semi")
    for row in gone.toLocalIterator():  # one folder each; nothing is rewritten
        remove(spark, f"{path}/capture_id={row['capture_id']}")


def delete_captures(spark: SparkSession, folder: str, names: list[str], captures: DataFrame) -> None:
    """Remove captures from the stored tables."""
    for name in names:
        delete_partitions(spark, f"{folder}/{name}", captures)


def append_new(rows: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key is not stored yet."""
    spark = rows.sparkSession
    if exists(spark, path):
        known = store(spark.read.parquet(path).select(*key), "stored-keys")
        rows = rows.join(known, key, "left_anti")
    rows.write.mode("append").parquet(path)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def context_of(tables: dict[str, DataFrame], capture_id: str) -> dict[str, DataFrame]:
    """The tables of one capture; partition pruning reads only its files."""
    return {name: t.where(F.col("capture_id") == capture_id) for name, t in tables.items()}


def csv_columns(table: DataFrame) -> DataFrame:
    """Values as an export writes them: bytes as hex, stamps as ISO text, nested values as JSON.

    Missing values stay missing and become empty fields.
    """
    columns = []
    for field in table.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.BinaryType):
            column = F.lower(F.hex(column))
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            column = F.to_json(column)
        columns.append(column.cast("string").alias(field.name))
    return table.select(*columns)


def export_csv(table: DataFrame, folder: str) -> None:
    csv_columns(table).write.mode("overwrite").option("header", True).csv(folder)


def feature_documents(
    features: DataFrame, feature_columns: list[str], per_document: int | None = None
) -> DataFrame:
    """Feature export as JSON documents, one for each flow.

    With ``per_document`` a document lists about so many flows of a capture and carries its position; each
    states the schema versions of the whole capture. How many flows a capture has changes nothing else.
    """
    versions = features.groupBy("capture_id").agg(
        F.array_sort(F.collect_set("feature_schema_version")).alias("feature_schema_versions"),
        F.count("*").alias("flows"),
    )
    entry = F.struct(
        "flow_key", "feature_schema_version", F.struct(*feature_columns).alias("features")
    )
    joined = features.join(versions, "capture_id")
    key = F.xxhash64("flow_key")
    if per_document is None:
        listed = joined.select("capture_id", key.alias("part"), "feature_schema_versions", F.array(entry).alias("features"))
    else:
        parts = F.greatest(F.ceil(F.col("flows") / F.lit(per_document)), F.lit(1))
        listed = (
            joined.withColumn("part", F.pmod(key, parts).cast("bigint"))
            .groupBy("capture_id", "part", "feature_schema_versions")
            .agg(F.array_sort(F.collect_list(entry)).alias("features"))
        )
    return listed.select(
        F.col("capture_id").alias("analysis_id"),
        "part",
        F.when(F.size("feature_schema_versions") == 1, F.col("feature_schema_versions")[0]).alias(
            "feature_schema_version"
        ),
        "feature_schema_versions",
        "features",
    )


def export_json(documents: DataFrame, folder: str) -> None:
    documents.write.mode("overwrite").json(folder)


def without_captures(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted captures."""
    gone = deleted.select("capture_id").distinct()
    return {name: table.join(gone, "capture_id", "left_anti") for name, table in tables.items()}
