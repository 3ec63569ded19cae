"""Capture files to analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import BURST_WINDOW_SECONDS
from flowlens.operators import decode, detect, features, flows
from flowlens.operators.sinks import append_new, write_tables
from flowlens.session import exists, store
from flowlens.sources import capture_files, catalogue, frames


def analyse_frames(
    frame_rows: DataFrame,
    burst_window: float = BURST_WINDOW_SECONDS,
    max_packets: int | None = None,
    keep: bool = True,
) -> dict[str, DataFrame]:
    """All analysis tables of a frames table.

    Packets and flows feed several tables, so they are stored once (``keep``) and the tables
    scan only the columns they need.
    """
    capped = frame_rows if max_packets is None else catalogue.cap_frames(frame_rows, max_packets)
    packets = decode.decode_packets(capped)
    packets = store(packets, "packets") if keep else packets
    flow_rows = flows.build_flows(packets)
    flow_rows = store(flow_rows, "flows") if keep else flow_rows
    messages = decode.ike_messages(packets)
    proposals = decode.ike_proposals(messages)
    observed = detect.observations_with_evidence(packets)
    esp, ah = decode.esp_packets(packets, flow_rows), decode.ah_packets(packets, flow_rows)
    tables = {
        "packets": packets,
        "observations": observed,
        "messages": messages.drop("sa_payload", "proposal_status"),
        "proposals": proposals,
        "esp": esp,
        "ah": ah,
        "flows": flow_rows,
        "features": features.flow_features(packets, flow_rows, burst_window),
    }
    counted = {
        "ike_message_count": packets.where("ike is not null").select("capture_id"),
        "esp_packet_count": packets.where("esp is not null").select("capture_id"),
        "ah_packet_count": packets.where("ah is not null").select("capture_id"),
        "flow_count": flow_rows.select("capture_id"),
    }
    tables["analyses"] = detect.analysis_summary(packets, observed, counted)
    return tables


def run_analysis(
    spark: SparkSession,
    source: str,
    target: str,
    burst_window: float = BURST_WINDOW_SECONDS,
    max_packets: int | None = None,
) -> None:
    """Scan a folder of captures and write every table, partitioned by capture.

    Tables of earlier runs stay. A file that is already stored keeps its capture id, and all its
    rows are replaced; new files get the next ids. ``max_packets`` bounds the frames of a capture.
    """
    listed = catalogue.list_files(spark, source)
    seen = store(capture_files.identify(listed), "identity")
    checked = store(catalogue.catalogue(listed.join(seen, "uri", "left")), "catalogue")
    known = None
    if exists(spark, f"{target}/captures"):
        known = store(spark.read.parquet(f"{target}/captures").select("capture_id", "sha256", "filename"), "known")
    captures = store(catalogue.accepted_captures(checked, known), "accepted")
    # ranges of files carry their capture's id, so frames are neither joined nor shuffled
    scanned = store(capture_files.scan_captures(captures.withColumnRenamed("file_size", "length")), "frames")
    captures = captures.drop("uri")
    readable = frames.readable_frames(scanned)
    tables = analyse_frames(readable, burst_window, max_packets)
    status = catalogue.capture_status(captures, tables["packets"])
    notes = catalogue.truncated_captures(readable, max_packets).join(
        frames.read_errors(scanned), "capture_id", "full_outer"
    )
    tables["captures"] = (
        captures.join(status, "capture_id")
        .join(notes.select("capture_id", "truncated", "read_error"), "capture_id", "left")
        .withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    )
    rejected = checked.where("reject_reason is not null").drop("uri")
    write_tables(tables, target, captures.select("capture_id"))
    append_new(rejected, f"{target}/rejected_files", ["path", "file_size", "reject_reason"])
