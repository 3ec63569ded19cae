"""Checks of flows, features, windows and detection over the packet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.contract import FEATURE_NAMES
from flowlens.functions.numeric import round_sql
from flowlens.operators import detect, features, flows
from flowlens.operators.decode import ah_packets, esp_packets
from flowlens.workload.base import MESSAGES_SQL, PACKETS_SQL, messages, packets

# events are minutes apart, so bursts are looked for within an hour
BURST = 3600.0


def r(value: str, digits: int) -> str:
    """The library's rounding as DuckDB text."""
    product = f"(({value}) * 1e{digits})"
    return round_sql(f"({value})", digits).replace(f"rint({product})", f"round_even({product}, 0)")


ELIGIBLE_SQL = PACKETS_SQL + """,
ends as (
  select *, concat(source, ':', coalesce(cast(source_port as varchar), 'x')) as se,
    concat(destination, ':', coalesce(cast(destination_port as varchar), 'x')) as de
  from pkt where protocol <> 'unknown' and source <> '' and destination <> ''),
fp as (
  select *, concat_ws('|', protocol, cast(ip_version as varchar), least(se, de), greatest(se, de))
    as flow_pair from ends)"""

FLOWS_SQL = ELIGIBLE_SQL + """,
head as (
  select capture_id, flow_pair, se as hs, de as hd, source as source_ip,
    destination as destination_ip, source_port, destination_port, protocol, transport, ip_version
  from (select *, row_number() over (partition by capture_id, flow_pair order by packet_id) as rn
    from fp) where rn = 1),
spis as (
  select capture_id, flow_pair, spi, row_number() over (partition by capture_id, flow_pair
    order by n desc, first_id) as rn
  from (select capture_id, flow_pair, spi, count(*) as n, min(packet_id) as first_id
    from fp where spi is not null group by 1, 2, 3)),
sums as (
  select fp.capture_id, fp.flow_pair, min(ts) as start_time, max(ts) as end_time,
    count(*) as packet_count, cast(sum(length) as bigint) as byte_count,
    count(*) filter (se = hs and de = hd) as upstream_packets,
    cast(coalesce(sum(length) filter (se = hs and de = hd), 0) as bigint) as upstream_bytes,
    count(*) filter (exchange_name is not null) as ike_packets,
    count(*) filter (fp.protocol = 'esp') as esp_packets,
    count(*) filter (fp.protocol = 'ah') as ah_packets
  from fp join head h on fp.capture_id = h.capture_id and fp.flow_pair = h.flow_pair
  group by 1, 2),
flow as (
  select s.capture_id, s.flow_pair,
    concat(hs, '-', protocol, '/', cast(ip_version as varchar), '->', hd) as flow_key,
    source_ip, destination_ip, source_port, destination_port, protocol, transport, ip_version,
    start_time, end_time, greatest(end_time - start_time, 0) as duration, packet_count, byte_count,
    upstream_packets, packet_count - upstream_packets as downstream_packets,
    upstream_bytes, byte_count - upstream_bytes as downstream_bytes,
    case when packet_count - upstream_packets > upstream_packets then 'reverse'
      when packet_count - upstream_packets = upstream_packets then 'unknown'
      else 'first_seen' end as direction,
    p.spi, ike_packets, esp_packets, ah_packets
  from sums s join head h on s.capture_id = h.capture_id and s.flow_pair = h.flow_pair
  left join spis p on s.capture_id = p.capture_id and s.flow_pair = p.flow_pair and p.rn = 1)"""

GAPS_SQL = """,
gap as (
  select capture_id, flow_pair, packet_id, ts, length, ts - lag(ts) over w as raw_gap
  from fp window w as (partition by capture_id, flow_pair order by packet_id)),
iat as (
  select capture_id, flow_pair, packet_id, greatest(raw_gap, 0) as interarrival
  from gap where raw_gap is not null)"""

ISLANDS_SQL = f""",
marked as (
  select *, sum(case when raw_gap > {BURST} then 1 else 0 end) over (
    partition by capture_id, flow_pair order by packet_id rows unbounded preceding) as run from gap),
island as (
  select capture_id, flow_pair, count(*) as size,
    greatest(arg_max(ts, packet_id) - arg_min(ts, packet_id), 0) as duration
  from marked group by capture_id, flow_pair, run)"""

_SIZES = f""",
size_raw as (
  select capture_id, flow_pair, count(*) as n, cast(sum(length) as double) / count(*) as mean,
    case when count(*) > 1 then sqrt(cast(count(*) * sum(cast(length as hugeint) * length)
      - sum(length) * sum(length) as double) / (cast(count(*) as double) * (count(*) - 1.0e0))) end as std,
    cast(min(length) as bigint) as packet_size_min, cast(max(length) as bigint) as packet_size_max,
    quantile_cont(length, 0.25) as p25, quantile_cont(length, 0.5) as p50,
    quantile_cont(length, 0.75) as p75
  from fp group by 1, 2),
sizes as (
  select capture_id, flow_pair, {r('mean', 2)} as packet_size_mean, {r('p50', 2)} as packet_size_median,
    {r('std', 2)} as packet_size_std, packet_size_min, packet_size_max,
    {r('p25', 2)} as packet_size_p25, {r('p75', 2)} as packet_size_p75 from size_raw)"""

_TIMES = f""",
time_raw as (
  select capture_id, flow_pair, avg(interarrival) as mean, quantile_cont(interarrival, 0.5) as median,
    stddev_samp(interarrival) as std, min(interarrival) as interarrival_min,
    max(interarrival) as interarrival_max from iat group by 1, 2),
times as (
  select capture_id, flow_pair, {r('mean', 6)} as interarrival_mean,
    {r('median', 6)} as interarrival_median, {r('std', 6)} as interarrival_std,
    interarrival_min, interarrival_max from time_raw)"""

_BURSTS = f""",
burst_raw as (
  select capture_id, flow_pair, cast(sum(size) as double) as packets,
    cast(count(*) filter (size > 1) as double) as bursts,
    cast(coalesce(sum(size) filter (size > 1), 0) as double) as held,
    cast(coalesce(max(size) filter (size > 1), 0) as double) as largest,
    coalesce(sum(duration) filter (size > 1), 0) as durations from island group by 1, 2),
burst as (
  select capture_id, flow_pair, bursts as burst_count, {r('held / packets', 4)} as burst_packets_ratio,
    {r('held / greatest(bursts, 1e0)', 2)} as burst_mean_size, largest as burst_max_size,
    {r('durations / greatest(bursts, 1e0)', 6)} as burst_mean_duration from burst_raw)"""

_RATES = f"""select capture_id, flow_pair, flow_key, packet_count, byte_count,
    {r('duration', 6)} as duration_seconds,
    {r('packet_count / nullif(duration, 0)', 4)} as packets_per_second,
    {r('byte_count / nullif(duration, 0)', 2)} as bytes_per_second,
    upstream_packets, downstream_packets, upstream_bytes, downstream_bytes,
    {r('upstream_packets / packet_count', 4)} as direction_ratio from flow"""

FEATURES_SQL = FLOWS_SQL + GAPS_SQL + ISLANDS_SQL + _SIZES + _TIMES + _BURSTS + f""",
rates as ({_RATES}),
feat as (
  select rates.*, s.* exclude (capture_id, flow_pair), t.* exclude (capture_id, flow_pair),
    b.* exclude (capture_id, flow_pair)
  from rates join sizes s using (capture_id, flow_pair)
  left join times t using (capture_id, flow_pair) join burst b using (capture_id, flow_pair))"""

_FEATURE_LIST = ", ".join(FEATURE_NAMES)

COUNTED_SQL = PACKETS_SQL + """,
counted as (
  select capture_id, packet_id, ts, length, concat('ipv', cast(ip_version as varchar)) as protocol,
    null as evidence from pkt
  union all
  select capture_id, packet_id, ts, length, protocol, case kind when 'click' then
    'IKE header parsed (IKEv2)' when 'error' then 'ESP header parsed (protocol 50)'
    when 'purchase' then 'AH header parsed (protocol 51)' end from pkt where protocol <> 'unknown'
  union all
  select capture_id, packet_id, ts, length, 'ike', concat('IKEv2 ', exchange_name) from pkt
    where exchange_name is not null
  union all
  select capture_id, packet_id, ts, length, 'natt', 'UDP 4500 — structure not parsed' from pkt
    where 4500 in (source_port, destination_port)),
obs as (
  select capture_id, protocol, count(*) as packet_count, cast(sum(length) as bigint) as byte_count,
    min(ts) as first_seen, max(ts) as last_seen, 'high' as confidence
  from counted group by capture_id, protocol),
verdict as (
  select capture_id, count(*) filter (exchange_name is not null) as ike_packets,
    count(*) filter (protocol = 'esp') as esp_packets, count(*) filter (protocol = 'ah') as ah_packets,
    count(*) filter (4500 in (source_port, destination_port)) as natt_packets
  from pkt group by capture_id),
verdicts as (
  select *, ike_packets + esp_packets + ah_packets > 0 as parsed from verdict)"""

_VERDICT = """select capture_id, case when parsed then 'yes' when natt_packets > 0 then 'unknown'
    else 'no' end as ipsec,
  case when not parsed and natt_packets > 0 then 'low' else 'high' end as confidence,
  case when parsed then concat('IPsec evidence: ike=', ike_packets, ', esp=', esp_packets, ', ah=',
      ah_packets)
    when natt_packets > 0 then 'UDP 500/4500 observed but no valid IKE/ESP/AH header parsed'
    else 'No IKE, ESP or AH packets observed' end as evidence,
  ike_packets, esp_packets, ah_packets, natt_packets from verdicts"""

_RECORDS = """select fp.capture_id, packet_id, ts, source as source_ip, destination as destination_ip,
  fp.spi, sequence_number, length,
  case when se = hs and de = hd then 'upstream' else 'downstream' end as direction, flow_key{extra}
  from fp join head h using (capture_id, flow_pair) join flow f using (capture_id, flow_pair)
  where fp.protocol = '{protocol}'"""


def flow_table(spark: SparkSession, folder: str) -> DataFrame:
    return flows.build_flows(packets(spark, folder))


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return features.flow_features(packets(spark, folder), window=BURST)


def _eligible(spark: SparkSession, folder: str) -> DataFrame:
    return flows.with_flow_pair(packets(spark, folder)).select("capture_id", "packet_id", "flow_pair")


def _layers(spark: SparkSession, folder: str) -> DataFrame:
    counts = [F.count_if(F.col(c).isNotNull()).alias(f"{c}_rows") for c in ("ike", "esp", "ah")]
    return packets(spark, folder).groupBy("capture_id").agg(*counts)


def _oriented(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder)
    return flows.orient(rows, flows.build_flows(rows)).select(
        "capture_id", "packet_id", "flow_key", "direction"
    )


def _dominant_spi(spark: SparkSession, folder: str) -> DataFrame:
    return flow_table(spark, folder).where("spi is not null").select("capture_id", "flow_key", "spi")


def _direction_labels(spark: SparkSession, folder: str) -> DataFrame:
    return flow_table(spark, folder).groupBy("capture_id", "direction").agg(
        F.count("*").alias("flows")
    )


def _islands(spark: SparkSession, folder: str) -> DataFrame:
    done, stitched = features.burst_islands(packets(spark, folder), BURST)
    return done.unionByName(stitched).where("size > 1").withColumn(
        "duration", F.round("duration", 6)
    )


def _small_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same bursts with chunks of 500 packets, so runs are stitched across chunk edges."""
    done, stitched = features.burst_islands(packets(spark, folder), BURST, chunk_rows=500)
    return done.unionByName(stitched).where("size > 1").withColumn(
        "duration", F.round("duration", 6)
    )


def _histogram(spark: SparkSession, folder: str) -> DataFrame:
    sized = features.size_features(packets(spark, folder))
    return sized.select(
        "capture_id", "flow_pair", F.inline("packet_size_histogram")
    )


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return features.size_features(packets(spark, folder)).drop("packet_size_histogram")


def _percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return features.size_features(packets(spark, folder)).select(
        "capture_id", "flow_pair", "packet_size_p25", "packet_size_median", "packet_size_p75"
    )


def _assembled(spark: SparkSession, folder: str) -> DataFrame:
    return feature_table(spark, folder).drop("packet_size_histogram")


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return detect.evidence_sample(packets(spark, folder)).withColumn(
        "evidence", F.array_join("evidence", "|")
    )


def summary_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder)
    return detect.analysis_summary(
        rows,
        detect.observations(rows),
        {
            "ike_message_count": rows.where("ike is not null"),
            "esp_packet_count": rows.where("esp is not null"),
            "ah_packet_count": rows.where("ah is not null"),
            "flow_count": flows.build_flows(rows),
        },
    )


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary_table(spark, folder).withColumn("protocols", F.array_join("protocols", ","))


def esp_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder)
    return esp_packets(rows, flows.build_flows(rows))


def ah_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder)
    return ah_packets(rows, flows.build_flows(rows))


def _joined_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = packets(spark, folder)
    table = flows.build_flows(rows)
    timed = features.interarrival_features(rows)
    return table.select("capture_id", "flow_pair", "flow_key", "protocol", "packet_count").join(
        timed.select("capture_id", "flow_pair", "interarrival_max"), ["capture_id", "flow_pair"]
    ).drop("flow_pair")


def _ordered(spark: SparkSession, folder: str) -> DataFrame:
    return flows.in_flow_order(flow_table(spark, folder)).select(
        "capture_id", "flow_key", "start_time", "packet_count"
    )


def _busiest(spark: SparkSession, folder: str) -> DataFrame:
    return detect.observations(packets(spark, folder)).select(
        "capture_id", "protocol", "packet_count"
    ).orderBy(F.col("packet_count").desc(), "capture_id", "protocol")


def _message_slice(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).withColumn("payload_types", F.array_join("payload_types", ","))


QUERIES = {
    "A1_flow_aggregate": flow_table,
    "F1_flow_eligibility": _eligible,
    "F2_layer_present": _layers,
    "J1_packet_to_flow": _oriented,
    "W4_first_seen_orientation": _oriented,
    "J2_esp_packet_direction": esp_table,
    "P20_ah_packet_records": ah_table,
    "A2_dominant_spi": _dominant_spi,
    "A3_flow_direction_label": _direction_labels,
    "L1_flow_order": _ordered,
    "W1_interarrival": lambda s, d: features.interarrivals(packets(s, d)),
    "W1_interarrival_small_chunks": lambda s, d: features.interarrivals(packets(s, d), 500),
    "W2_burst_islands": _islands,
    "W2_burst_islands_small_chunks": _small_chunks,
    "A9_size_statistics": _sizes,
    "A10_exact_percentile": _percentiles,
    "A11_rates_and_ratios": lambda s, d: features.flow_rates(flow_table(s, d)),
    "A12_interarrival_statistics": lambda s, d: features.interarrival_features(packets(s, d)),
    "A13_burst_statistics": lambda s, d: features.burst_features(packets(s, d), BURST),
    "A14_size_histogram": _histogram,
    "A15_feature_assembly": _assembled,
    "J3_features_to_flow": _joined_features,
    "A4_protocol_observations": lambda s, d: detect.observations(packets(s, d)),
    "A5_evidence_sample": _evidence,
    "A6_detection_totals": lambda s, d: detect.detection_totals(packets(s, d)),
    "A7_ipsec_verdict": lambda s, d: detect.verdict(packets(s, d)),
    "A8_analysis_summary": _summary,
    "L7_observations_by_volume": _busiest,
    "P19_ike_message_projection": _message_slice,
}

_EDGES = ((0, 64, "1-64"), (64, 256, "65-256"), (256, 1024, "257-1024"), (1024, 4096, "1025-4096"),
          (4096, 65536, "4097-65536"), (65536, 1 << 40, ">65536"))
_HISTOGRAM = " union all ".join(
    f"select capture_id, flow_pair, '{label}' as \"range\", c{i} as count, "
    + r(f"cast(c{i} as double) / n", 4) + " as share from h"
    for i, (_, _, label) in enumerate(_EDGES)
)
_BUCKETS = ", ".join(
    f"count(*) filter (length >= {low} and length < {high}) as c{i}"
    for i, (low, high, _) in enumerate(_EDGES)
)
_ORIENTED = """ select pkt.capture_id, packet_id, flow_key, case when flow_key is null then 'unknown'
    when o.se = hs and o.de = hd then 'upstream' else 'downstream' end as direction
  from pkt left join (select fp.capture_id, fp.packet_id, se, de, hs, hd, flow_key from fp
    join head h using (capture_id, flow_pair) join flow f using (capture_id, flow_pair)) o
  using (capture_id, packet_id)"""
_ISLAND_SELECT = (
    " select capture_id, flow_pair, size, round(duration, 6) as duration from island where size > 1"
)

ORACLES = {
    "A1_flow_aggregate": FLOWS_SQL + " select * from flow",
    "F1_flow_eligibility": ELIGIBLE_SQL + " select capture_id, packet_id, flow_pair from fp",
    "F2_layer_present": PACKETS_SQL
    + " select capture_id, count(exchange_name) as ike_rows, count(*) filter (protocol = 'esp') as"
    " esp_rows, count(*) filter (protocol = 'ah') as ah_rows from pkt group by 1",
    "J1_packet_to_flow": FLOWS_SQL + _ORIENTED,
    "W4_first_seen_orientation": FLOWS_SQL + _ORIENTED,
    "J2_esp_packet_direction": FLOWS_SQL
    + " " + _RECORDS.format(extra=", 'UNKNOWN' as encryption_algorithm", protocol="esp"),
    "P20_ah_packet_records": FLOWS_SQL
    + " " + _RECORDS.format(extra=", 4 as next_header", protocol="ah"),
    "A2_dominant_spi": FLOWS_SQL + " select capture_id, flow_key, spi from flow where spi is not null",
    "A3_flow_direction_label": FLOWS_SQL
    + " select capture_id, direction, count(*) as flows from flow group by 1, 2",
    "L1_flow_order": FLOWS_SQL
    + " select capture_id, flow_key, start_time, packet_count from flow"
    " order by start_time, packet_count desc, capture_id, flow_key",
    "W1_interarrival": ELIGIBLE_SQL + GAPS_SQL + " select * from iat",
    "W1_interarrival_small_chunks": ELIGIBLE_SQL + GAPS_SQL + " select * from iat",
    "W2_burst_islands": ELIGIBLE_SQL + GAPS_SQL + ISLANDS_SQL + _ISLAND_SELECT,
    "W2_burst_islands_small_chunks": ELIGIBLE_SQL + GAPS_SQL + ISLANDS_SQL + _ISLAND_SELECT,
    "A9_size_statistics": ELIGIBLE_SQL + _SIZES + " select * from sizes",
    "A10_exact_percentile": ELIGIBLE_SQL + _SIZES
    + " select capture_id, flow_pair, packet_size_p25, packet_size_median, packet_size_p75 from sizes",
    "A11_rates_and_ratios": FLOWS_SQL + " " + _RATES,
    "A12_interarrival_statistics": ELIGIBLE_SQL + GAPS_SQL + _TIMES + " select * from times",
    "A13_burst_statistics": ELIGIBLE_SQL + GAPS_SQL + ISLANDS_SQL + _BURSTS + " select * from burst",
    "A14_size_histogram": ELIGIBLE_SQL
    + f", h as (select capture_id, flow_pair, count(*) as n, {_BUCKETS} from fp group by 1, 2) "
    + _HISTOGRAM,
    "A15_feature_assembly": FEATURES_SQL
    + f" select capture_id, flow_pair, flow_key, {_FEATURE_LIST}, '1.0' as feature_schema_version"
    " from feat",
    "J3_features_to_flow": FLOWS_SQL + GAPS_SQL + _TIMES
    + " select capture_id, flow_key, protocol, packet_count, interarrival_max from flow"
    " join times using (capture_id, flow_pair)",
    "A4_protocol_observations": COUNTED_SQL + " select * from obs",
    "A5_evidence_sample": COUNTED_SQL
    + """, ranked as (select *, row_number() over (partition by capture_id, protocol order by
      packet_id) as rn from counted where evidence is not null)
      select capture_id, protocol, string_agg(evidence, '|' order by rn) as evidence from ranked
      where rn <= 3 group by 1, 2""",
    "A6_detection_totals": PACKETS_SQL
    + """ select capture_id, count(*) as packet_count, cast(sum(length) as bigint) as byte_count,
      min(ts) as first_packet_time, max(ts) as last_packet_time, max(ts) - min(ts) as duration
      from pkt group by 1""",
    "A7_ipsec_verdict": COUNTED_SQL + " " + _VERDICT,
    "A8_analysis_summary": COUNTED_SQL.replace(PACKETS_SQL, FLOWS_SQL)
    + f""", v as ({_VERDICT}),
      flags as (select capture_id, bool_or(protocol = 'ike') as ike_detected,
        max(case when protocol in ('ike', 'natt') then 'high' end) as ike_confidence,
        bool_or(protocol = 'esp') as esp_detected, bool_or(protocol = 'ah') as ah_detected,
        bool_or(protocol = 'ipv4') as ipv4_detected, bool_or(protocol = 'ipv6') as ipv6_detected,
        string_agg(protocol, ',' order by packet_count desc, protocol) as protocols
        from obs group by 1),
      tot as (select capture_id, count(*) as packet_count, cast(sum(length) as bigint) as byte_count,
        min(ts) as first_packet_time, max(ts) as last_packet_time, max(ts) - min(ts) as duration,
        count(exchange_name) as ike_message_count, count(*) filter (protocol = 'esp') as
        esp_packet_count, count(*) filter (protocol = 'ah') as ah_packet_count from pkt group by 1),
      fc as (select capture_id, count(*) as flow_count from flow group by 1)
      select tot.*, ipsec, confidence, flags.* exclude (capture_id), coalesce(flow_count, 0) as
      flow_count from tot join v using (capture_id) left join flags using (capture_id)
      left join fc using (capture_id)""",
    "L7_observations_by_volume": COUNTED_SQL
    + " select capture_id, protocol, packet_count from obs order by 3 desc, 1, 2",
    "P19_ike_message_projection": MESSAGES_SQL
    + """ select m.capture_id, ike_message_id, m.packet_id, m.ts, source_ip, destination_ip,
      m.exchange_name, m.initiator_spi, m.responder_spi, direction, case
      when m.exchange_name = 'IKE_SA_INIT' then 'SA,KE,NONCE'
      when m.exchange_name = 'CREATE_CHILD_SA' and has_ke then 'SA,KE'
      when m.exchange_name = 'CREATE_CHILD_SA' then 'SA' else 'SK' end as payload_types from msg m""",
}
