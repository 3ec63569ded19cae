"""Protocol observations, IPsec verdict and per-analysis summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: counted protocols and evidence texts -----------------------------------
TRANSPORT_OBSERVED = ("udp", "tcp", "icmp", "icmpv6", "esp", "ah")
NATT_PARSED = "UDP 4500 (NAT-T) carries IPsec"
NATT_OPAQUE = "UDP 4500 — structure not parsed"
VERDICT_UNKNOWN = "UDP 500/4500 observed but no valid IKE/ESP/AH header parsed"
VERDICT_NO = "No IKE, ESP or AH packets observed"
IKE_PORT, NATT_PORT = 500, 4500


def _on_port(port: int) -> Column:
    either = (F.col("source_port") == port) | (F.col("destination_port") == port)
    return F.coalesce(either, F.lit(False))


def _counters() -> Column:
    """The counters a packet feeds, each with the evidence text it offers."""

    def entry(name: Column, evidence: Column) -> Column:
        return F.struct(name.alias("protocol"), evidence.cast("string").alias("evidence"))

    silent = F.lit(None)
    ike, esp = F.col("ike").isNotNull(), F.col("esp").isNotNull()
    natt_text = F.when(ike | esp, F.lit(NATT_PARSED)).when(
        F.col("protocol") == "udp", F.lit(NATT_OPAQUE)
    )
    return F.array_compact(
        F.array(
            F.when(F.col("ip_version") == 4, entry(F.lit("ipv4"), silent)).when(
                F.col("ip_version") == 6, entry(F.lit("ipv6"), silent)
            ),
            F.when(
                F.col("protocol").isin(*TRANSPORT_OBSERVED),
                entry(F.col("protocol"), F.try_element_at("evidence", F.lit(1))),
            ),
            F.when(
                ike,
                entry(F.lit("ike"), F.concat_ws(" ", "ike.version", "ike.exchange_name")),
            ),
            F.when(_on_port(NATT_PORT) & natt_text.isNotNull(), entry(F.lit("natt"), natt_text)),
        )
    )


def counted(packets: DataFrame) -> DataFrame:
    """One row per packet and counter it feeds."""
    return packets.select(
        "capture_id", "packet_id", "ts", "length", F.inline(_counters())
    )


def observations(packets: DataFrame) -> DataFrame:
    """Packets, bytes, first and last stamp per capture and protocol."""
    return (
        counted(packets)
        .groupBy("capture_id", "protocol")
        .agg(
            F.count("*").alias("packet_count"),
            F.sum(F.col("length").cast("bigint")).alias("byte_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .withColumn("confidence", F.lit("high"))
    )


def evidence_sample(packets: DataFrame, size: int = 3) -> DataFrame:
    """First ``size`` non-empty evidence texts per protocol in packet order.

    The rank limit is applied before the shuffle too, so each task sends at most ``size`` rows
    per group.
    """
    order = Window.partitionBy("capture_id", "protocol").orderBy("packet_id")
    return (
        counted(packets)
        .where("evidence IS NOT NULL AND evidence <> ''")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= size)
        .groupBy("capture_id", "protocol")
        .agg(F.array_sort(F.collect_list(F.struct("position", "evidence"))).alias("ranked"))
        .select("capture_id", "protocol", F.col("ranked.evidence").alias("evidence"))
    )


def observations_with_evidence(packets: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    joined = observations(packets).join(
        evidence_sample(packets), ["capture_id", "protocol"], "left"
    )
    return joined.withColumn("evidence", F.coalesce("evidence", empty))


def detection_totals(packets: DataFrame) -> DataFrame:
    """Packets, bytes, first/last stamp and duration per capture."""
    totals = packets.groupBy("capture_id").agg(
        F.count("*").alias("packet_count"),
        F.sum(F.col("length").cast("bigint")).alias("byte_count"),
        F.min("ts").alias("first_packet_time"),
        F.max("ts").alias("last_packet_time"),
    )
    return totals.withColumn("duration", F.col("last_packet_time") - F.col("first_packet_time"))


def verdict(packets: DataFrame) -> DataFrame:
    """Is there IPsec in the capture: yes, no, or unknown (its ports without a parsed header)."""
    ike, esp = F.col("ike").isNotNull(), F.col("esp").isNotNull()
    natt = _on_port(NATT_PORT) & (ike | esp | (F.col("protocol") == "udp"))
    seen = packets.groupBy("capture_id").agg(
        F.count_if(ike).alias("ike_packets"),
        F.count_if(F.col("protocol") == "esp").alias("esp_packets"),
        F.count_if(F.col("protocol") == "ah").alias("ah_packets"),
        F.count_if(_on_port(IKE_PORT) & ~ike).alias("unparsed_ike_port"),
        F.count_if(natt).alias("natt_packets"),
    )
    parsed = F.col("ike_packets") + F.col("esp_packets") + F.col("ah_packets") > 0
    ports = (F.col("unparsed_ike_port") > 0) | (F.col("natt_packets") > 0)
    counts = F.format_string(
        "IPsec evidence: ike=%d, esp=%d, ah=%d",
        F.col("ike_packets"),
        F.col("esp_packets"),
        F.col("ah_packets"),
    )
    return seen.select(
        "capture_id",
        F.when(parsed, "yes").when(ports, "unknown").otherwise("no").alias("ipsec"),
        F.when(~parsed & ports, "low").otherwise("high").alias("confidence"),
        F.when(parsed, counts)
        .when(ports, F.lit(VERDICT_UNKNOWN))
        .otherwise(F.lit(VERDICT_NO))
        .alias("evidence"),
        "ike_packets",
        "esp_packets",
        "ah_packets",
        "natt_packets",
    )


def analysis_summary(
    packets: DataFrame,
    observed: DataFrame,
    children: dict[str, DataFrame],
) -> DataFrame:
    """Detected flags, confidences, protocols by volume and child row counts per analysis.

    ``children`` maps an output count column to a table carrying ``capture_id``.
    """

    def seen(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("protocol") == name), F.lit(False))

    def confidence_of(name: str) -> Column:
        return F.max(F.when(F.col("protocol") == name, F.col("confidence")))

    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("packet_count")).alias("rank"), F.col("protocol").alias("protocol")))
    )
    flags = observed.groupBy("capture_id").agg(
        seen("ike").alias("ike_detected"),
        F.coalesce(confidence_of("ike"), confidence_of("natt")).alias("ike_confidence"),
        seen("esp").alias("esp_detected"),
        seen("ah").alias("ah_detected"),
        seen("ipv4").alias("ipv4_detected"),
        seen("ipv6").alias("ipv6_detected"),
        ranked.alias("ranked"),
    )
    result = (
        detection_totals(packets)
        .join(verdict(packets).select("capture_id", "ipsec", "confidence"), "capture_id")
        .join(flags, "capture_id", "left")
        .withColumn("protocols", F.col("ranked.protocol"))
        .drop("ranked")
    )
    for name, table in children.items():
        counts = table.groupBy("capture_id").agg(F.count("*").alias(name))
        result = result.join(counts, "capture_id", "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(0)).cast("bigint")
        )
    return result
