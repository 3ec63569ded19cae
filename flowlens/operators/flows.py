"""Bidirectional flows (eligibility, aggregation, dominant SPI, orientation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.keys import endpoint_sql, flow_key_sql, flow_pair_sql

FLOW = ["capture_id", "flow_pair"]
_ELIGIBLE = "protocol <> 'unknown' and source <> '' and destination <> ''"
_ENDPOINT = ("source", "destination", "source_port", "destination_port")
# packets sent by the smaller endpoint; self-conversations always count as such
_FORWARD = (
    f"{endpoint_sql('source', 'source_port')} <= {endpoint_sql('destination', 'destination_port')}"
)


def eligible(packets: DataFrame) -> DataFrame:
    """Packets that belong to a flow: known protocol and both addresses present."""
    return packets.where(_ELIGIBLE)


def with_flow_pair(packets: DataFrame) -> DataFrame:
    """Eligible packets carrying their undirected flow key."""
    return eligible(packets).selectExpr("*", f"{flow_pair_sql()} as flow_pair")


def build_flows(packets: DataFrame) -> DataFrame:
    """One row per capture and endpoint pair.

    Two additive aggregations, (flow, spi) then (flow), both combined map-side: a conversation
    holding most of the packets shuffles only its partial sums. Direction counts are kept for the
    smaller endpoint's side and turned into up/down once the first packet is known, so no window
    over the packets of a flow is needed.
    """
    head = ", ".join(
        f"'{c}', {c}" for c in ("packet_id", *_ENDPOINT, "protocol", "transport", "ip_version")
    )
    rows = with_flow_pair(packets).selectExpr(
        *FLOW,
        "packet_id",
        "ts",
        "cast(length as bigint) as length",
        "coalesce(esp.spi, ah.spi) as spi",
        "cast(ike is not null as bigint) as is_ike",
        "cast(esp is not null as bigint) as is_esp",
        "cast(ah is not null as bigint) as is_ah",
        f"{_FORWARD} as forward",
        f"named_struct({head}, 'forward', {_FORWARD}) as head",
    )
    forward = F.col("forward")
    by_spi = rows.groupBy(*FLOW, "spi").agg(
        F.min_by("head", "packet_id").alias("head"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("packets"),
        F.sum("length").alias("bytes"),
        F.sum(F.when(forward, 1).otherwise(0)).alias("forward_packets"),
        F.sum(F.when(forward, F.col("length")).otherwise(0)).alias("forward_bytes"),
        F.sum("is_ike").alias("ike_packets"),
        F.sum("is_esp").alias("esp_packets"),
        F.sum("is_ah").alias("ah_packets"),
    )
    spi_rank = F.when(
        F.col("spi").isNotNull() & (F.col("spi") != ""),
        F.struct(F.col("packets").alias("n"), (-F.col("head.packet_id")).alias("first")),
    )
    merged = by_spi.groupBy(*FLOW).agg(
        F.min_by("head", "head.packet_id").alias("head"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("packets").alias("packet_count"),
        F.sum("bytes").alias("byte_count"),
        F.sum("forward_packets").alias("forward_packets"),
        F.sum("forward_bytes").alias("forward_bytes"),
        F.max_by("spi", spi_rank).alias("spi"),
        F.sum("ike_packets").alias("ike_packets"),
        F.sum("esp_packets").alias("esp_packets"),
        F.sum("ah_packets").alias("ah_packets"),
    )
    sides = merged.selectExpr(
        "*",
        "if(head.forward, forward_packets, packet_count - forward_packets) as upstream_packets",
        "if(head.forward, forward_bytes, byte_count - forward_bytes) as upstream_bytes",
    )
    return sides.selectExpr(
        *FLOW,
        f"{flow_key_sql('head.')} as flow_key",
        "head.source as source_ip",
        "head.destination as destination_ip",
        "head.source_port",
        "head.destination_port",
        "head.protocol",
        "head.transport",
        "head.ip_version",
        "start_time",
        "end_time",
        "greatest(end_time - start_time, 0e0) as duration",
        "packet_count",
        "byte_count",
        "upstream_packets",
        "packet_count - upstream_packets as downstream_packets",
        "upstream_bytes",
        "byte_count - upstream_bytes as downstream_bytes",
        """case when packet_count - upstream_packets > upstream_packets then 'reverse'
            when packet_count - upstream_packets = upstream_packets then 'unknown'
            else 'first_seen' end as direction""",
        "spi",
        "ike_packets",
        "esp_packets",
        "ah_packets",
    )


def orient(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets with their flow's directed key and ``upstream``/``downstream``/``unknown``.

    A left join on the flow: one flow row meets all its packets, so a hot flow is split by the
    adaptive skew join. Packets outside any flow keep a NULL key and direction ``unknown``.
    """
    keyed = packets.selectExpr("*", f"case when {_ELIGIBLE} then {flow_pair_sql()} end as flow_pair")
    heads = flows.selectExpr(
        *FLOW,
        "flow_key",
        "source_ip as _source",
        "destination_ip as _destination",
        "source_port as _source_port",
        "destination_port as _destination_port",
    )
    return (
        keyed.join(heads, FLOW, "left")
        .selectExpr(
            "*",
            """case when flow_key is null then 'unknown'
                when source = _source and destination = _destination
                  and source_port <=> _source_port and destination_port <=> _destination_port
                then 'upstream' else 'downstream' end as direction""",
        )
        .drop("_source", "_destination", "_source_port", "_destination_port")
    )


def in_flow_order(flows: DataFrame) -> DataFrame:
    """Start time, larger flows first, key as tie break."""
    return flows.orderBy("start_time", F.col("packet_count").desc(), "capture_id", "flow_key")
