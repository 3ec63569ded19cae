"""Checks of capture scanning and decoding on bytes that Spark builds from the packet log.

Every packet of the log is rendered as an Ethernet or raw IP frame, decoded again, and compared
with the log in DuckDB. Capture files are the same frames joined into pcap and pcapng bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import decode, sinks
from flowlens.operators.dims import ENCRYPTION, INTEGRITY, PRF
from flowlens.session import shared_folder, store
from flowlens.sources import capture_files, catalogue, frames, label_file, packet_source
from flowlens.workload.base import MESSAGES_SQL, PACKETS_SQL, packets, raw_packets, read
from flowlens.workload.stored import stored
from flowlens.workload.traffic import FEATURES_SQL, FLOWS_SQL, feature_table, flow_table

#: bytes of a file that one task reads at once, so that captures of the log spread over several
RANGE = 1 << 18
#: tasks for each core that build and decode frames: bytes of a frame cost far more than its row of the log
TASKS_A_CORE = 4


def _h(value: str, digits: int) -> str:
    return f"lpad(hex(cast({value} as bigint)), {digits}, '0')"


def _le(value: str, width: int) -> str:
    text = _h(value, 2 * width)
    pairs = ", ".join(f"substr({text}, {2 * i + 1}, 2)" for i in reversed(range(width)))
    return f"concat({pairs})"


def _transform(kind: int, code: str, attributes: str = "''") -> str:
    size = f"8 + length({attributes}) / 2"
    return f"concat('0000', {_h(size, 4)}, '{kind:02X}00', {_h(code, 4)}, {attributes})"


_KEY_BITS = "64 * (event_id % 5)"
_CIPHER, _MAC, _PRF, _DH = (
    "1 + event_id % 26", "event_id % 14", "1 + event_id % 9", "event_id % 32",
)
_ATTRIBUTE = f"if(event_id % 3 = 0, '', concat('8E00', {_h(_KEY_BITS, 4)}))"


def _proposal(number: int, protocol: str, transforms: list[str], more: int) -> str:
    body = f"concat({', '.join(transforms)})"
    return (
        f"concat('{more:02X}00', {_h(f'8 + length({body}) / 2', 4)}, '{number:02X}', "
        f"{_h(protocol, 2)}, '00', '{len(transforms):02X}', {body})"
    )


def _payload(following: int, body: str) -> str:
    return f"concat('{following:02X}00', {_h(f'4 + length({body}) / 2', 4)}, {body})"


_FIRST = _proposal(
    1,
    "1 + event_id % 3",
    [_transform(1, _CIPHER, _ATTRIBUTE), _transform(3, _MAC), _transform(2, _PRF), _transform(4, _DH)],
    2,
)
_SECOND = _proposal(2, "3", [_transform(1, "12"), _transform(5, "event_id % 2")], 0)
_SA = f"concat({_FIRST}, {_SECOND})"
_KE, _NONCE = _payload(40, "'0013000000000000'"), _payload(0, "'AABBCCDD'")
_BODY = f"""case exchange_name
  when 'IKE_SA_INIT' then concat({_payload(34, _SA)}, {_KE}, {_NONCE})
  when 'CREATE_CHILD_SA' then if(cap < 6, concat({_payload(34, _SA)}, {_payload(0, "'0013'")}),
    {_payload(0, _SA)})
  else {_payload(35, "'00112233445566'")} end"""
_IKE = f"""concat(upper(initiator_spi), upper(responder_spi),
  if(exchange_name in ('IKE_SA_INIT', 'CREATE_CHILD_SA'), '21', '2E'), '20',
  case exchange_name when 'IKE_SA_INIT' then '22' when 'IKE_AUTH' then '23'
    when 'CREATE_CHILD_SA' then '24' else '25' end,
  {_h('flags', 2)}, {_h('event_id', 8)}, {_h('28 + length(body) / 2', 8)}, body)"""
_UDP_DATA = f"case when kind = 'click' then {_IKE} else 'FFFFFFFF' end"
_PORTS = f"concat({_h('source_port', 4)}, {_h('destination_port', 4)})"
_TRANSPORT = f"""case protocol
  when 'tcp' then concat({_PORTS}, repeat('00', 16))
  when 'udp' then concat({_PORTS}, {_h('8 + length(data) / 2', 4)}, '0000', data)
  when 'esp' then concat(upper(spi), {_h('sequence_number', 8)}, repeat('5A', 16))
  when 'ah' then concat('04000000', upper(spi), {_h('sequence_number', 8)}, repeat('00', 12))
  else repeat('77', 12) end"""
_PROTO = "case protocol when 'tcp' then 6 when 'udp' then 17 when 'esp' then 50 when 'ah' then 51 else 99 end"


def _ip_address(n: str, net4: str, net6: str) -> str:
    four = f"concat('{net4}', {_h(f'{n} % 16777216', 6)})"
    return f"if(ip_version = 6, concat('FD00{net6}', repeat('00', 8), {_h(n, 8)}), {four})"


_A, _B = _ip_address("an", "0A", "0001"), _ip_address("bn", "AC", "0002")
_SRC, _DST = f"if(flip, {_B}, {_A})", f"if(flip, {_A}, {_B})"


def _ip(extra: str, fragment: str) -> str:
    """IP header before the transport bytes; ``extra`` are IPv6 extension headers."""
    v4 = (
        f"concat('4500', {_h('20 + length(transport_hex) / 2', 4)}, '0000', {fragment}, '40', "
        f"{_h(_PROTO, 2)}, '0000', src, dst)"
    )
    v6 = (
        f"concat('60000000', {_h(f'(length({extra}) + length(transport_hex)) / 2', 4)}, "
        f"first_header, '40', src, dst, {extra})"
    )
    return f"if(ip_version = 6, {v6}, {v4})"


_LINKS = {0: "0800", 1: "8100", 2: "88A8"}
_ETHER = "if(ip_version = 6, '86DD', '0800')"
_LINK = f"""case event_id % 4 when 3 then ''
  when 0 then concat('00112233445566778899AABB', {_ETHER})
  when 1 then concat('00112233445566778899AABB81000005', {_ETHER})
  else concat('00112233445566778899AABB88A80005', {_ETHER}) end"""


def frame_rows(
    spark: SparkSession, folder: str, extensions: str = "''", first_header: str | None = None,
    fragment: str = "'0000'",
) -> DataFrame:
    """Frames of the packet log. Ethernet padding fills frames up to the logged length.

    The log is small beside its frames and may be one split, so its rows are dealt out first.
    """
    rows = raw_packets(spark, folder, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    built = rows.selectExpr("*", f"case when kind = 'click' then {_BODY} end as body")
    built = built.selectExpr("*", f"{_UDP_DATA} as data", f"{_SRC} as src", f"{_DST} as dst")
    built = built.selectExpr(
        "*",
        f"{_TRANSPORT} as transport_hex",
        f"{extensions} as extension_hex",
        f"{first_header or _h(_PROTO, 2)} as first_header",
    )
    whole = f"concat({_LINK}, {_ip('extension_hex', fragment)}, transport_hex)"
    built = built.selectExpr("*", f"{whole} as frame_hex")
    return built.selectExpr(
        "capture_id",
        "packet_id as frame_number",
        "cast(floor(us / 1e6) as bigint) as seconds",
        "us % 1000000 as micros",
        "ts",
        "unhex(rpad(frame_hex, greatest(length(frame_hex), 2 * length), '0')) as data",
    )


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    return decode.decode_packets(frame_rows(spark, folder))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "decoded", _decoded)


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    """Link, IP and transport fields."""
    return decoded(spark, folder).select(
        "capture_id", "packet_id", "ts", "source", "destination", "ip_version", "protocol", "transport",
        "source_port", "destination_port", "fragmented", F.array_join("evidence", "|").alias("evidence"),
    )


def _spis(spark: SparkSession, folder: str) -> DataFrame:
    rows = decoded(spark, folder)
    esp = rows.where("esp is not null").selectExpr("capture_id", "packet_id", "'esp' as layer", "esp.spi", "esp.sequence_number")
    ah = rows.where("ah is not null").selectExpr("capture_id", "packet_id", "'ah' as layer", "ah.spi", "ah.sequence_number")
    return esp.unionByName(ah)


def _ike_headers(spark: SparkSession, folder: str) -> DataFrame:
    return decode.ike_messages(decoded(spark, folder)).select(
        "capture_id", "packet_id", "version", "exchange_name", "exchange_type", "flags", "next_payload",
        "initiator_spi", "responder_spi", "message_id", "direction", "proposal_status",
    )


def _chains(spark: SparkSession, folder: str) -> DataFrame:
    return decode.ike_messages(decoded(spark, folder)).select(
        "capture_id", "packet_id", F.array_join("payload_types", ",").alias("payload_types"),
        F.col("sa_payload").isNotNull().alias("has_sa"),
    )


def _sa_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return decode.ike_messages(decoded(spark, folder)).where("sa_payload is not null").select(
        "capture_id", "packet_id", F.octet_length("sa_payload").alias("sa_length")
    )


def _proposal_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.ike_proposals(decode.ike_messages(decoded(spark, folder)))
    return rows.drop("ike_message_id")


def _v1_messages(spark: SparkSession, folder: str) -> DataFrame:
    """IKEv1 SA payloads: one proposal per packet, two transforms, short and long attributes."""
    attributes = (
        f"concat('80040080', '0006000400000001', '8005', {_h('1 + event_id % 11', 4)}, "
        f"'00030004', {_h('event_id % 25', 8)}, if(event_id % 2 = 0, '800B00C0', ''))"
    )
    first = f"concat('0300', {_h(f'8 + length({attributes}) / 2', 4)}, '01', {_h('event_id % 10', 2)}, '0000', {attributes})"
    second = f"concat('0000', {_h('8 + 4', 4)}, '02', '0B0000', '8006', {_h('event_id % 4', 4)})"
    body = f"concat({first}, {second})"
    rows = raw_packets(spark, folder).where("kind = 'click'")
    return rows.selectExpr(
        "capture_id",
        "packet_id as ike_message_id",
        "packet_id",
        "'IKEv1' as version",
        "'OFFERED' as proposal_status",
        f"unhex(concat('0000', {_h(f'8 + length({body}) / 2', 4)}, '01', {_h('2 + event_id % 2', 2)}, "
        f"'0002', {body})) as sa_payload",
    )


def _v1_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return decode.ike_proposals(_v1_messages(spark, folder)).select(
        "packet_id", "protocol_name", "encryption", "key_length", "integrity", "prf", "dh_group",
        "transform_confidence",
    )


def _extension_frames(spark: SparkSession, folder: str) -> DataFrame:
    """IPv6 packets behind 0 to 3 extension headers, some of them fragments."""
    proto = _h(_PROTO, 2)
    # chain by event: none / destination options / hop-by-hop + destination / + fragment header
    chain = f"""case event_id % 4 when 0 then ''
      when 1 then concat({proto}, '01', repeat('00', 14))
      when 2 then concat('3C00', repeat('00', 6), {proto}, '01', repeat('00', 14))
      else concat('3C00', repeat('00', 6), '2C01', repeat('00', 14), {proto}, '000001', repeat('00', 4)) end"""
    first = f"case event_id % 4 when 0 then {proto} when 1 then '3C' else '00' end"
    return frame_rows(spark, folder, chain, first)


def _extension_packets(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.decode_packets(_extension_frames(spark, folder)).where("ip_version = 6")
    return rows.select(
        "capture_id", "packet_id", "protocol", "transport", "source_port", "destination_port", "fragmented"
    )


def _fragment_packets(spark: SparkSession, folder: str) -> DataFrame:
    """IPv4 packets, every other one a fragment."""
    marked = frame_rows(spark, folder, fragment="if(event_id % 2 = 0, '2000', '0000')")
    rows = decode.decode_packets(marked).where("ip_version = 4")
    return rows.select(
        "capture_id", "packet_id", "protocol", "transport", "source_port", "destination_port",
        "fragmented", F.array_join("evidence", "|").alias("evidence"),
    )


# ---- capture files -------------------------------------------------------------------------
def _written_files(records: DataFrame, header: str, record: str, suffix: str, name: str) -> DataFrame:
    """Every capture written as one file: (capture_id, uri, length)."""
    spark = records.sparkSession
    rows = records.selectExpr(
        "capture_id", "frame_number", f"unhex({header}) as header", f"unhex({record}) as record"
    )
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    capture_files.write_captures(rows, target, suffix)
    files = catalogue.list_files(spark, target)
    return files.selectExpr(f"replace(filename, '{suffix}', '') as capture_id", "filename", "uri", "length")


def pcap_files(spark: SparkSession, folder: str) -> DataFrame:
    """Big-endian µs, little-endian µs and big-endian ns captures."""
    layout = "cast(substr(capture_id, 5) as int) % 3"
    size = "octet_length(data)"
    # magic, version 2.4, zone, accuracy, snap length, Ethernet
    rest = "00020004" + "00000000" * 2 + "0000FFFF" + "00000001"
    header = f"""case {layout} when 0 then 'A1B2C3D4{rest}'
        when 1 then 'D4C3B2A1{"02000400" + "00000000" * 2 + "FFFF0000" + "01000000"}'
        else 'A1B23C4D{rest}' end"""
    big = f"concat({_h('seconds', 8)}, {{}}, {_h(size, 8)}, {_h(size, 8)}, hex(data))"
    record = f"""case {layout} when 0 then {big.format(_h('micros', 8))}
        when 1 then concat({_le('seconds', 4)}, {_le('micros', 4)}, {_le(size, 4)}, {_le(size, 4)}, hex(data))
        else {big.format(_h('micros * 1000', 8))} end"""
    return _written_files(frame_rows(spark, folder), header, record, ".pcap", "pcap")


def pcapng_files(spark: SparkSession, folder: str) -> DataFrame:
    """Little-endian pcapng: section, Ethernet interface with microseconds, enhanced packets."""
    header = (
        "'0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"
        "01000000200000000100000000000400090001000600000000000000" + "20000000'"
    )
    size = "octet_length(data)"
    padded = f"(4 * ceil({size} / 4.0e0))"
    total = f"32 + {padded}"
    stamp = "(seconds * 1000000 + micros)"
    record = f"""concat('06000000', {_le(total, 4)}, '00000000', {_le(f'shiftright({stamp}, 32)', 4)},
        {_le(f'{stamp} & 4294967295', 4)}, {_le(size, 4)}, {_le(size, 4)},
        rpad(hex(data), cast(2 * {padded} as int), '0'), {_le(total, 4)})"""
    return _written_files(frame_rows(spark, folder), header, record, ".pcapng", "pcapng")


def _lengths(scanned: DataFrame) -> DataFrame:
    return frames.readable_frames(scanned).select(
        "capture_id", "frame_number", "ts", F.octet_length("data").alias("length"), "orig_length"
    )


def _scanned(files: DataFrame) -> DataFrame:
    return _lengths(capture_files.scan_captures(files, range_bytes=RANGE))


def _source(spark: SparkSession, folder: str) -> DataFrame:
    """Some captures' middle frames, through the registered format and a stored index."""
    files = stored(spark, folder, "pcap_files", pcap_files)
    target = f"{shared_folder(spark)}/frame-index-{uuid.uuid4().hex}"
    capture_files.write_index(files, target, range_bytes=RANGE)
    packet_source.register(spark)
    source = spark.read.format(packet_source.FORMAT).options(index=target, rangeBytes=RANGE, pushFilters=True).load()
    return _lengths(source.where("capture_id in ('CAP-000001', 'CAP-000002') and frame_number between 200 and 900"))


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Capture files under good and bad names and contents, written and read again."""
    n = "cast(substr(capture_id, 5, 6) as int)"
    rows = frame_rows(spark, folder).select("capture_id", "frame_number").selectExpr(
        f"""concat(capture_id, case {n} % 6 when 0 then '.pcap' when 1 then '.CAP'
            when 2 then '.txt' when 3 then '.pcapng' when 4 then '' else '.pcap' end) as capture_id""",
        "frame_number",
        f"unhex(if({n} % 12 = 3, '00112233', 'D4C3B2A102000400{'00' * 8}FFFF000001000000')) as header",
        f"unhex(if({n} % 12 = 3, '', repeat('00', 16))) as record",
    )
    target = f"{shared_folder(spark)}/named-{uuid.uuid4().hex}"
    capture_files.write_captures(rows, target, "")
    files = catalogue.list_files(spark, target)
    checked = catalogue.catalogue(files.join(store(capture_files.identify(files), "identity"), "uri", "left"))
    return checked.select("filename", "file_size", "capture_format", "reject_reason")


def _captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of the log plus one silent capture per nation."""
    seen = packets(spark, folder).select("capture_id").distinct()
    silent = read(spark, folder, "nation").selectExpr("concat('CAP-9', lpad(n_nationkey, 5, '0')) as capture_id")
    return seen.unionByName(silent)


def _status(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.capture_status(_captures(spark, folder), packets(spark, folder))


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder).withColumnRenamed("packet_id", "frame_number")
    return catalogue.truncated_captures(rows, 9990)


def _label_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Label files written from ``labels`` and read back."""
    path = f"{shared_folder(spark)}/label-files-{spark.sparkContext.applicationId}"
    entry = F.struct(
        F.when(F.col("quality") == 1, "web").otherwise("voip").alias("traffic_type"),
        F.concat(F.lit("CAP-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("capture_id"),
    )
    documents = (
        read(spark, folder, "labels")
        .withColumn("bucket", F.floor(F.col("doc_id") / 100))
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry")))).alias("rows"))
        .select(
            "bucket",
            F.to_json(
                F.struct(
                    F.lit("user_provided").alias("label_source"),
                    F.lit("1.0").alias("feature_schema_version"),
                    F.lit("1.0").alias("class_definition_version"),
                    F.col("rows.entry").alias("labels"),
                )
            ).alias("value"),
        )
    )
    documents.write.mode("overwrite").partitionBy("bucket").text(path)
    return label_file.read_labels(spark, path).select(
        "index", "label_source", "traffic_type", "capture_id"
    )


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """Flow and observation tables written by capture and counted after reading back."""
    target = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    sinks.write_tables({"flows": flow_table(spark, folder)}, target)
    back = sinks.read_tables(spark, target, ["flows"])["flows"]
    return back.groupBy("capture_id").agg(
        F.count("*").alias("flows"), F.sum("byte_count").alias("bytes")
    )


def _one_capture(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{shared_folder(spark)}/context-{spark.sparkContext.applicationId}"
    sinks.write_tables({"packets": packets(spark, folder).select("capture_id", "packet_id", "protocol")}, target)
    back = sinks.read_tables(spark, target, ["packets"])
    return sinks.context_of(back, "CAP-000003")["packets"].select("capture_id", "packet_id", "protocol").orderBy(
        "packet_id"
    )


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{shared_folder(spark)}/csv-{spark.sparkContext.applicationId}"
    table = flow_table(spark, folder).select(
        "capture_id", "flow_key", "source_port", "packet_count", "direction",
        F.array("protocol", "direction").alias("tags"),
    )
    sinks.export_csv(table, target)
    schema = "capture_id string, flow_key string, source_port string, packet_count string, direction string, tags string"
    return spark.read.schema(schema).option("header", True).option("escape", "\\").csv(target)


def _json(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one flow, and of about fifty, summed up per capture after being read back."""
    rows = stored(spark, folder, "features", feature_table)
    parts = []
    for per_document in (None, 50):
        target = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
        sinks.export_json(sinks.feature_documents(rows, ["packet_count", "byte_count"], per_document), target)
        found = spark.read.schema(
            "analysis_id string, part long, feature_schema_version string, "
            "features array<struct<flow_key:string, features:struct<packet_count:long, byte_count:long>>>"
        ).json(target)
        parts.append(
            found.select("analysis_id", "part", "feature_schema_version", F.explode("features").alias("f"))
            .groupBy("analysis_id", "feature_schema_version")
            .agg(
                F.lit("flow" if per_document is None else "fifty").alias("documents_of"),
                (F.count_distinct("part") > 1).alias("several"),
                F.count("*").alias("flows"),
                F.sum("f.features.packet_count").alias("packets"),
                F.min("f.flow_key").alias("first_flow"),
            )
        )
    return parts[0].unionByName(parts[1])


def _deleted(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder)
    gone = rows.select("capture_id").distinct().where("cast(substr(capture_id, 5) as int) % 3 = 0")
    left = sinks.without_captures({"packets": rows, "flows": flow_table(spark, folder)}, gone)
    counts = [
        table.groupBy("capture_id").agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        for name, table in left.items()
    ]
    return counts[0].unionByName(counts[1])


QUERIES = {
    "P1_P2_P4_P5_P6_P10_headers": _headers,
    "P3_ipv6_extension_chain": _extension_packets,
    "P7_P8_esp_ah_headers": _spis,
    "P9_fragments": _fragment_packets,
    "P11_ike_header": _ike_headers,
    "P12_payload_chain": _chains,
    "P13_sa_payload": _sa_bodies,
    "P14_P15_P16_ikev2_proposals": _proposal_rows,
    "P17_ikev1_proposals": _v1_proposals,
    "S1_capture_catalogue": _catalogue,
    "S2_W5_pcap_frames": lambda s, d: _scanned(stored(s, d, "pcap_files", pcap_files)),
    "S2_packet_source": _source,
    "S3_pcapng_frames": lambda s, d: _scanned(stored(s, d, "pcapng_files", pcapng_files)),
    "S4_frame_cap": _truncated,
    "S5_undecodable_capture": _status,
    "S6_F10_context_slice": _one_capture,
    "S7_label_file": _label_entries,
    "S8_table_sink": _written,
    "S9_csv_export": _csv,
    "S10_json_export": _json,
    "S11_delete_cascade": _deleted,
}

_IKE_TEXT = "case kind when 'click' then 'IKE header parsed (IKEv2)' when 'error' then 'ESP header parsed (protocol 50)' when 'purchase' then 'AH header parsed (protocol 51)' else '' end"


def _arms(table: dict, key: str, prefix: str) -> str:
    arms = " ".join(f"when {code} then '{name}'" for code, name in table.items())
    return f"case {key} {arms} else concat('{prefix}', {key}) end"


_V2_ROWS = f"""
  select capture_id, packet_id, 1 as proposal_number, cast(1 + event_id % 3 as int) as protocol_id,
    case event_id % 3 when 0 then 'IKE' when 1 then 'AH' else 'ESP' end as protocol_name,
    {_arms(ENCRYPTION, f'({_CIPHER})', 'ENCR_')} as encryption, cast({_CIPHER} as int) as encryption_id,
    case when event_id % 3 = 0 then null else {_KEY_BITS} end as key_length,
    {_arms(INTEGRITY, f'({_MAC})', 'INTEG_')} as integrity, cast({_MAC} as int) as integrity_id,
    {_arms(PRF, f'({_PRF})', 'PRF_')} as prf, cast({_PRF} as int) as prf_id,
    cast({_DH} as int) as dh_group, null as esn, 'high' as transform_confidence,
    case when flags = 1 then 'OFFERED' else 'SELECTED' end as status
  from pkt where exchange_name in ('IKE_SA_INIT', 'CREATE_CHILD_SA')
  union all
  select capture_id, packet_id, 2, 3, 'ESP', 'AES_CBC', 12, null, 'UNKNOWN', null, 'UNKNOWN', null,
    null, cast(event_id % 2 as int), 'high', case when flags = 1 then 'OFFERED' else 'SELECTED' end
  from pkt where exchange_name in ('IKE_SA_INIT', 'CREATE_CHILD_SA')"""
_NUMBERED = "capture_id, row_number() over (partition by capture_id order by packet_id) as frame_number"
_IP_BYTES = "case when ip_version = 6 then 40 else 20 end"
_LINK_BYTES = "case event_id % 4 when 3 then 0 when 0 then 14 else 18 end"
_PAYLOAD_BYTES = """case when protocol = 'tcp' then 20 when kind = 'click' then 36 + case exchange_name
    when 'IKE_SA_INIT' then 4 + sa + 12 + 8 when 'CREATE_CHILD_SA' then 4 + sa + case when cap < 6 then 6 else 0 end
    else 11 end
  when protocol = 'udp' then 12 when protocol = 'esp' then 24 when protocol = 'ah' then 24 else 12 end"""
_LENGTHS = f"""
  select *, greatest(length, {_LINK_BYTES} + {_IP_BYTES} + {_PAYLOAD_BYTES}) as frame_length
  from (select *, 8 + 32 + case when event_id % 3 = 0 then 0 else 4 end + 8 + 16 as sa from pkt)"""
_SECONDS = "cast(us // 1000000 as double) + cast(us % 1000000 as double) * 1e-6"
_NANOS = "cast(us // 1000000 as double) + cast(us % 1000000 * 1000 as double) * 1e-9"

ORACLES = {
    "P1_P2_P4_P5_P6_P10_headers": PACKETS_SQL
    + f""" select capture_id, packet_id, ts, source, destination, ip_version, protocol, transport,
      source_port, destination_port, false as fragmented, {_IKE_TEXT} as evidence from pkt""",
    "P3_ipv6_extension_chain": PACKETS_SQL
    + """ select capture_id, packet_id,
      case when event_id % 4 = 3 and protocol not in ('tcp', 'udp') then 'unknown' else protocol end as protocol,
      transport, case when event_id % 4 <> 3 then source_port end as source_port,
      case when event_id % 4 <> 3 then destination_port end as destination_port,
      event_id % 4 = 3 as fragmented from pkt where ip_version = 6""",
    "P7_P8_esp_ah_headers": PACKETS_SQL
    + " select capture_id, packet_id, protocol as layer, spi, sequence_number from pkt"
    " where spi is not null",
    "P9_fragments": PACKETS_SQL
    + f""" select capture_id, packet_id,
      case when event_id % 2 = 0 and protocol not in ('tcp', 'udp') then 'unknown' else protocol end as protocol,
      transport, case when event_id % 2 = 1 then source_port end as source_port,
      case when event_id % 2 = 1 then destination_port end as destination_port,
      event_id % 2 = 0 as fragmented,
      case when event_id % 2 = 1 then {_IKE_TEXT} when protocol in ('tcp', 'udp')
        then 'IP fragment — transport ports not dissected'
        else 'IP fragment — transport not dissected' end as evidence
      from pkt where ip_version = 4""",
    "P11_ike_header": MESSAGES_SQL
    + """ select m.capture_id, m.packet_id, 'IKEv2' as version, m.exchange_name,
      case m.exchange_name when 'IKE_SA_INIT' then 34 when 'IKE_AUTH' then 35
        when 'CREATE_CHILD_SA' then 36 else 37 end as exchange_type, flags,
      case when m.exchange_name in ('IKE_SA_INIT', 'CREATE_CHILD_SA') then 33 else 46 end as next_payload,
      m.initiator_spi, m.responder_spi, lpad(lower(hex(m.event_id)), 8, '0') as message_id, m.direction,
      case when m.direction = 'initiator' then 'OFFERED' else 'SELECTED' end as proposal_status
      from msg m join pkt using (capture_id, packet_id)""",
    "P12_payload_chain": MESSAGES_SQL
    + """ select capture_id, packet_id, case when exchange_name = 'IKE_SA_INIT' then 'SA,KE,NONCE'
      when exchange_name = 'CREATE_CHILD_SA' and has_ke then 'SA,KE'
      when exchange_name = 'CREATE_CHILD_SA' then 'SA' else 'SK' end as payload_types,
      exchange_name in ('IKE_SA_INIT', 'CREATE_CHILD_SA') as has_sa from msg""",
    "P13_sa_payload": PACKETS_SQL
    + """ select capture_id, packet_id, 8 + 32 + case when event_id % 3 = 0 then 0 else 4 end + 8 + 16 as sa_length
      from pkt where exchange_name in ('IKE_SA_INIT', 'CREATE_CHILD_SA')""",
    "P14_P15_P16_ikev2_proposals": PACKETS_SQL + _V2_ROWS,
    "P17_ikev1_proposals": PACKETS_SQL
    + """ select packet_id, case event_id % 2 when 0 then 'AH' else 'ESP' end as protocol_name,
      case event_id % 10 when 1 then 'DES_CBC' when 5 then '3DES_CBC' when 7 then 'AES_CBC'
        when 8 then 'AES_CTR' else 'UNKNOWN' end as encryption,
      case when event_id % 10 in (1, 5, 7, 8) then 128 end as key_length,
      case event_id % 4 when 1 then 'MD5' when 2 then 'SHA1' else concat('HASH_', event_id % 4) end as integrity,
      case 1 + event_id % 11 when 1 then 'PSK' when 2 then 'DSS' when 3 then 'RSA_SIG' when 4 then 'RSA_ENC'
        when 5 then 'RSA_ENC_REV' when 6 then 'EL_GAMAL' when 7 then 'EL_GAMAL_REV' when 8 then 'ECDSA_SHA'
        when 9 then 'X509_SIG' else 'AUTH_UNKNOWN' end as prf,
      cast(event_id % 25 as int) as dh_group, 'high' as transform_confidence
      from pkt where kind = 'click'""",
    "S1_capture_catalogue": PACKETS_SQL
    + """, f as (select capture_id as name, cap + 1 as n, count(*) as frames from pkt group by all),
      g as (select concat(name, case n % 6 when 0 then '.pcap' when 1 then '.CAP' when 2 then '.txt'
          when 3 then '.pcapng' when 4 then '' else '.pcap' end) as filename,
        case when n % 12 = 3 then 4 else 24 + 16 * frames end as file_size,
        case when n % 6 in (2, 4) then 'unsupported_extension'
          when n % 12 = 3 then 'unrecognised_content' end as reject_reason from f)
      select filename, file_size, case when reject_reason is null then 'pcap' end as capture_format,
        reject_reason from g""",
    "S2_W5_pcap_frames": PACKETS_SQL
    + f" select {_NUMBERED}, case when (cap + 1) % 3 = 2 then {_NANOS} else {_SECONDS} end as ts,"
    f" frame_length as length, frame_length as orig_length from ({_LENGTHS})",
    "S2_packet_source": PACKETS_SQL
    + f""" select * from (select {_NUMBERED}, case when (cap + 1) % 3 = 2 then {_NANOS} else {_SECONDS} end as ts,
      frame_length as length, frame_length as orig_length from ({_LENGTHS}))
      where capture_id in ('CAP-000001', 'CAP-000002') and frame_number between 200 and 900""",
    "S3_pcapng_frames": PACKETS_SQL
    + f" select {_NUMBERED}, us * 1e-6 as ts, frame_length as length, frame_length as orig_length"
    f" from ({_LENGTHS})",
    "S4_frame_cap": PACKETS_SQL
    + " select capture_id, count(*) as frames, count(*) filter (packet_id <= 9990) as kept_frames,"
    " max(packet_id) > 9990 as truncated from pkt group by 1",
    "S5_undecodable_capture": PACKETS_SQL
    + """ select capture_id, count(*) as packet_count, 'completed' as status, null as error_code,
      null as error_message from pkt group by 1 union all
      select concat('CAP-9', lpad(cast(n_nationkey as varchar), 5, '0')), 0, 'failed', 'PARSER_ERROR',
      'No parseable packets found in the capture.' from nation""",
    "S6_F10_context_slice": PACKETS_SQL
    + " select capture_id, packet_id, protocol from pkt where capture_id = 'CAP-000003' order by 2",
    "S7_label_file": """select cast(row_number() over (partition by doc_id // 100 order by doc_id) - 1 as int)
      as "index", 'user_provided' as label_source, case when quality = 1 then 'web' else 'voip' end as
      traffic_type, concat('CAP-', lpad(cast(doc_id as varchar), 6, '0')) as capture_id from labels""",
    "S8_table_sink": FLOWS_SQL
    + " select capture_id, count(*) as flows, cast(sum(byte_count) as bigint) as bytes from flow group by 1",
    "S9_csv_export": FLOWS_SQL
    + """ select capture_id, flow_key, cast(source_port as varchar) as source_port,
      cast(packet_count as varchar) as packet_count, direction,
      concat('["', protocol, '","', direction, '"]') as tags from flow""",
    "S10_json_export": FLOWS_SQL
    + """ select capture_id as analysis_id, '1.0' as feature_schema_version, documents_of,
      count(*) > case documents_of when 'flow' then 1 else 50 end as several, count(*) as flows,
      cast(sum(packet_count) as bigint) as packets, min(flow_key) as first_flow
      from flow, (values ('flow'), ('fifty')) as d(documents_of) group by 1, 2, documents_of""",
    "S11_delete_cascade": FLOWS_SQL
    + """ select capture_id, count(*) as rows, 'packets' as table_name from pkt
      where cast(substr(capture_id, 5) as int) % 3 <> 0 group by 1 union all
      select capture_id, count(*), 'flows' from flow
      where cast(substr(capture_id, 5) as int) % 3 <> 0 group by 1""",
}
