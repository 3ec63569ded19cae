"""Analysis tables to stored findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import findings, rules
from flowlens.operators.sinks import append_new, read_tables
from flowlens.session import exists, store

_TABLES = ["analyses", "messages", "proposals", "esp", "ah", "observations"]


def assessable(analyses: DataFrame, captures: DataFrame) -> DataFrame:
    """Analyses of completed captures; others are not assessed."""
    done = captures.where("status = 'completed'").select("capture_id")
    return analyses.join(done, "capture_id", "left_semi")


def assess(
    tables: rules.Tables, existing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New findings with ids, their evidence chunks, and the per-rule summary.

    Running twice on the same tables adds nothing the second time.
    """
    found, chunks = rules.evaluate_rules(tables)
    found, chunks = store(found, "findings"), store(chunks, "chunks")
    if existing is None:
        existing = found.where("false").withColumn("finding_id", F.lit(None).cast("string"))
    fresh = findings.new_findings(found, existing)
    numbered = findings.number_findings(fresh, existing)
    cited = chunks.join(fresh.select(*findings.FINDING), findings.FINDING, "left_semi")
    summary = findings.assessment_summary(found, existing, [r.rule_id for r in rules.RULES])
    return findings.evidence_struct(numbered), cited, summary


def run_assessment(spark: SparkSession, folder: str) -> DataFrame:
    """Assess the tables under ``folder``, append what is new, return the summary.

    Findings and evidence are appended by batch, so stored findings are never rewritten.
    """
    tables = read_tables(spark, folder, _TABLES)
    captures = read_tables(spark, folder, ["captures"])["captures"]
    tables["analyses"] = assessable(tables["analyses"], captures)
    existing = None
    if exists(spark, f"{folder}/findings"):
        stored = spark.read.parquet(f"{folder}/findings")
        existing = store(stored.select("finding_id", *findings.IDENTITY), "known_findings")
    fresh, cited, summary = assess(tables, existing)
    fresh, cited, summary = store(fresh, "fresh"), store(cited, "cited"), store(summary, "summary")
    # evidence of findings that a broken run did not store is not appended again
    append_new(cited, f"{folder}/finding_evidence", [*findings.FINDING, "kind", "chunk", "chunk_digest"])
    fresh.write.mode("append").parquet(f"{folder}/findings")
    return summary
