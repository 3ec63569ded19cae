"""Evidence, digests and idempotent assessment.

A finding can cite every packet of a capture, so evidence is not one array: it is a table of
chunks of at most 10 000 packet positions. The digest is a two-level hash over those chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.contract import EVIDENCE_VERSION, RULES_VERSION
from flowlens.functions.keys import EVIDENCE_CHUNK
from flowlens.functions.ordering import human_id, human_number, number_rows

FINDING = ["capture_id", "rule_id", "group_key"]
ITEM = ["item_source", "item_field", "item_observed", "item_expected", "observation_status"]
IDENTITY = ["capture_id", "rule_id", "evidence_digest"]


def evidence_chunks(refs: DataFrame) -> DataFrame:
    """Distinct cited packets per finding, kind and position range, ascending.

    ``kind`` is ``packet`` or ``message``; the message id of a position is
    ``capture_id:packet_id``.
    """
    chunk = F.floor(F.col("packet_id") / EVIDENCE_CHUNK).cast("bigint")
    return (
        refs.groupBy(*FINDING, "kind", chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_set("packet_id")).alias("packet_ids"))
        .withColumn(
            "chunk_digest",
            F.sha2(F.array_join(F.col("packet_ids").cast("array<string>"), ","), 256),
        )
    )


def evidence_digests(chunks: DataFrame) -> DataFrame:
    """Cited counts and the ordered chunk hashes of every finding."""
    entry = F.concat_ws(":", "kind", F.lpad(F.col("chunk").cast("string"), 12, "0"), "chunk_digest")

    def cited(kind: str):
        return F.sum(F.when(F.col("kind") == kind, F.size("packet_ids")).otherwise(0)).cast("bigint")

    return chunks.groupBy(*FINDING).agg(
        cited("packet").alias("packet_refs"),
        cited("message").alias("message_refs"),
        F.array_join(F.array_sort(F.collect_list(entry)), "|").alias("refs_digest"),
    )


def with_digest(heads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings with the SHA-256 over their evidence item and cited packets; notes stay out."""
    joined = heads.join(evidence_digests(chunks), FINDING, "left").fillna(
        {"packet_refs": 0, "message_refs": 0, "refs_digest": ""}
    )
    return joined.withColumn(
        "evidence_digest", F.sha2(F.concat_ws("|", *ITEM, "refs_digest"), 256)
    ).drop("refs_digest")


def evidence_struct(findings: DataFrame) -> DataFrame:
    """The finding-level part of the evidence as one nested column (cited ids: the chunk table)."""
    item = F.struct(
        F.col("item_source").alias("source"),
        F.col("item_field").alias("field"),
        F.col("item_observed").alias("observed_value"),
        F.col("item_expected").alias("expected_value"),
        "observation_status",
    )
    return findings.withColumn(
        "evidence",
        F.struct(
            F.lit(EVIDENCE_VERSION).alias("version"),
            F.array(item).alias("items"),
            F.col("packet_refs"),
            F.col("message_refs"),
            F.array("note").alias("notes"),
        ),
    )


def new_findings(findings: DataFrame, existing: DataFrame) -> DataFrame:
    """Findings not yet stored; identical evidence for the same analysis and rule is skipped."""
    return findings.join(existing.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def number_findings(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """``SEC-`` ids continuing after the highest stored number."""
    highest = existing.agg(
        F.coalesce(F.max(human_number("SEC", F.col("finding_id"))), F.lit(0)).alias("n")
    ).scalar()
    order = [F.col("evidence_digest"), F.col("capture_id"), F.col("rule_id")]
    numbered = number_rows(fresh, order, F.substring("evidence_digest", 1, 3), "number")
    return numbered.withColumn("finding_id", human_id("SEC", F.col("number") + highest)).drop("number")


def assessment_summary(
    findings: DataFrame, existing: DataFrame, rule_ids: list[str]
) -> DataFrame:
    """Created and skipped findings per rule, rules without findings included."""
    known = existing.select(*IDENTITY).distinct().withColumn("known", F.lit(True))
    counts = (
        findings.join(known, IDENTITY, "left")
        .groupBy("rule_id")
        .agg(
            F.count_if(F.col("known").isNull()).alias("created"),
            F.count_if(F.col("known").isNotNull()).alias("skipped"),
        )
    )
    names = ", ".join(f"('{rule}')" for rule in rule_ids)
    rules = findings.sparkSession.sql(f"SELECT * FROM VALUES {names} AS rules(rule_id)")
    return rules.join(counts, "rule_id", "left").select(
        "rule_id",
        F.lit(RULES_VERSION).alias("rule_version"),
        F.coalesce("created", F.lit(0)).cast("bigint").alias("created"),
        F.coalesce("skipped", F.lit(0)).cast("bigint").alias("skipped"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity, one column each; a missing severity counts as INFO."""
    name = F.upper(F.coalesce("severity", F.lit("info")))
    return findings.groupBy("capture_id").agg(
        F.count("*").alias("total"),
        *[
            F.count_if(name == level).alias(level.lower())
            for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
        ],
    )
