"""Checks of the security rules, replay scan, evidence and assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import dims, findings, replay, rules, views
from flowlens.operators.decode import ah_packets, esp_packets
from flowlens.operators.detect import observations, verdict
from flowlens.operators.flows import build_flows
from flowlens.workload.base import (
    PACKETS_SQL,
    PROPOSALS_SQL,
    messages,
    messages_of,
    packets,
    proposals,
    proposals_of,
)
from flowlens.workload.stored import stored
from flowlens.workload.traffic import COUNTED_SQL, FLOWS_SQL


def tables(spark: SparkSession, folder: str) -> rules.Tables:
    """The stored analysis tables every rule reads, made from one stored packet table."""
    log = stored(spark, folder, "packets", packets)
    sent = stored(spark, folder, "messages", lambda s, d: messages_of(log))
    sides = stored(spark, folder, "flows", lambda s, d: build_flows(log))
    builders = {
        "analyses": lambda s, d: verdict(log),
        "messages": lambda s, d: sent,
        "proposals": lambda s, d: proposals_of(s, d, sent),
        "esp": lambda s, d: esp_packets(log, sides),
        "ah": lambda s, d: ah_packets(log, sides),
        "observations": lambda s, d: observations(log),
    }
    return {name: stored(spark, folder, name, build) for name, build in builders.items()}


SHOWN = [
    "capture_id",
    "rule_id",
    "group_key",
    "severity",
    "finding_type",
    "confidence",
    "item_observed",
    "note",
    "observed_value",
    "packet_refs",
    "message_refs",
    "evidence_digest",
]


def _rule(rule_id: str):
    chosen = tuple(rule for rule in rules.RULES if rule.rule_id == rule_id)

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rules.evaluate_rules(tables(spark, folder), chosen)[0].select(*SHOWN)

    return query


def finding_table(spark: SparkSession, folder: str) -> DataFrame:
    return rules.evaluate_rules(tables(spark, folder))[0]


def stored_findings(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "findings", finding_table)


def _stored(found: DataFrame) -> DataFrame:
    """Findings as an earlier run left them: those of every other capture."""
    return found.where("cast(substr(capture_id, 5) as int) % 2 = 0")


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    found = stored_findings(spark, folder)
    return findings.assessment_summary(found, _stored(found), [r.rule_id for r in rules.RULES])


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    found = stored_findings(spark, folder)
    return findings.new_findings(found, _stored(found)).select(
        "capture_id", "rule_id", "group_key", "evidence_digest"
    )


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    found = stored_findings(spark, folder)
    none = found.where("false").withColumn("finding_id", F.lit(None).cast("string"))
    return findings.number_findings(found, none).select("finding_id", "evidence_digest", "capture_id")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = rules.evaluate_rules(tables(spark, folder))[1]
    return chunks.select(
        "capture_id", "rule_id", "group_key", "kind", "chunk", F.size("packet_ids").alias("cited"),
        "chunk_digest",
    )


def _severities(spark: SparkSession, folder: str) -> DataFrame:
    return findings.severity_counts(stored_findings(spark, folder))


def _newest_findings(spark: SparkSession, folder: str) -> DataFrame:
    dated = stored_findings(spark, folder).withColumn(
        "created_at", F.conv(F.substring("evidence_digest", 1, 8), 16, 10).cast("bigint")
    )
    return views.newest_first(dated, "created_at", "evidence_digest").select(
        "created_at", "rule_id", "capture_id"
    )


def _anomalies(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder)
    return replay.replay_anomalies(replay.sequence_observations(t["esp"], t["ah"]))


def _wide_observations(spark: SparkSession, folder: str) -> DataFrame:
    """All packets of one protocol and direction of a capture as one long SA."""
    t = tables(spark, folder)
    return replay.sequence_observations(t["esp"], t["ah"]).withColumn("spi", F.lit("all"))


def _long_sa(spark: SparkSession, folder: str) -> DataFrame:
    return replay.replay_anomalies(_wide_observations(spark, folder), chunk_rows=1000)


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    found = replay.replay_anomalies(_wide_observations(spark, folder))
    return replay.first_anomalies(found, 25).select(
        "capture_id", "source_table", "position", "packet_id", "sequence_number"
    )


def _predicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = proposals(spark, folder)
    return rows.groupBy("capture_id").agg(
        F.count_if(dims.is_unknown_encryption(F.col("encryption"))).alias("unknown_encryption"),
        F.count_if(dims.is_unknown_value(F.col("encryption"))).alias("unknown_value"),
    )


def _unresolved(spark: SparkSession, folder: str) -> DataFrame:
    flags = [dims.is_unresolved_transform(F.col(c)) for c in ("integrity", "prf")]
    return proposals(spark, folder).groupBy("capture_id", "status").agg(
        F.count_if(flags[0]).alias("integrity_unresolved"), F.count_if(flags[1]).alias("prf_unresolved")
    )


def _weak(spark: SparkSession, folder: str) -> DataFrame:
    return (
        proposals(spark, folder)
        .withColumn("severity", dims.weak_encryption_severity())
        .where("severity is not null")
        .groupBy("encryption", "key_length", "severity")
        .agg(F.count("*").alias("n"))
    )


def _weak_dh(spark: SparkSession, folder: str) -> DataFrame:
    return (
        proposals(spark, folder)
        .withColumn("severity", dims.weak_dh_severity())
        .where("severity is not null")
        .groupBy("dh_group", "severity")
        .agg(F.count("*").alias("n"))
    )


def _exchange_sets(spark: SparkSession, folder: str) -> DataFrame:
    def member(names: tuple[str, ...]):
        return F.count_if(F.col("exchange_name").isin(*names))

    return messages(spark, folder).groupBy("capture_id").agg(
        member(dims.SETUP_EXCHANGES).alias("setup"),
        member(dims.PROGRESS_EXCHANGES).alias("progress"),
        member(dims.CHILD_EXCHANGES).alias("child"),
    )


def _plaintext(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(packets(spark, folder))
    return rows.where(dims.is_plaintext_protocol(F.col("protocol"))).select(
        "capture_id", "protocol", "packet_count"
    )


def _child_proposals(spark: SparkSession, folder: str) -> DataFrame:
    child = messages(spark, folder).where(F.col("exchange_name").isin(*dims.CHILD_EXCHANGES))
    return proposals(spark, folder).join(
        child.select("ike_message_id"), "ike_message_id", "left_semi"
    ).select("ike_message_id", "proposal_number", "dh_group")


def _sa_keys(spark: SparkSession, folder: str) -> DataFrame:
    return rules.conflicting_groups(tables(spark, folder))[1]


def _dual_sas(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder)
    keys = ["capture_id", "spi", "direction"]
    return t["esp"].select(*keys).intersect(t["ah"].select(*keys))


def _dual_packets(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder)
    keys = ["capture_id", "spi", "direction"]
    shared = t["esp"].select(*keys).intersect(t["ah"].select(*keys))
    return t["esp"].join(shared, keys, "left_semi").select(*keys, "packet_id")


def _messages_with_proposals(spark: SparkSession, folder: str) -> DataFrame:
    nested = views.messages_with_proposals(messages(spark, folder), proposals(spark, folder))
    return nested.select(
        "ike_message_id",
        F.size("proposals").alias("proposal_count"),
        F.array_join(F.col("proposals.encryption"), ",").alias("encryptions"),
    )


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Registered names for numeric codes found in the data."""
    codes = proposals(spark, folder).where("dh_group is not null").groupBy("dh_group").agg(
        F.count("*").alias("n")
    )
    return codes.select("dh_group", dims.lookup(dims.DH_GROUPS, "dh_group").alias("name"), "n")


_RULE_KEYS = {
    "A16_unknown_encryption": "IPSEC-CRYPTO-001",
    "A17_weak_encryption": "IPSEC-CRYPTO-002",
    "A18_weak_dh": "IPSEC-DH-001",
    "A19_pfs_not_observed": "IPSEC-PFS-001",
    "A20_incomplete_negotiation": "IPSEC-IKE-001",
    "A21_A22_selected_sa": "IPSEC-SA-001",
    "A23_plaintext_beside_ipsec": "IPSEC-META-001",
    "A24_initiation_frequency": "IPSEC-META-002",
    "A25_dual_protection": "IPSEC-COMPOSITE-001",
    "A26_replay": "IPSEC-REPLAY-001",
}

QUERIES = {
    "F3_unknown_value": _predicates,
    "F4_unresolved_transform": _unresolved,
    "F5_weak_encryption": _weak,
    "F6_weak_dh": _weak_dh,
    "F7_exchange_sets": _exchange_sets,
    "F8_plaintext_protocols": _plaintext,
    "P18_code_names": _names,
    "J7_child_proposals": _child_proposals,
    "J8_proposal_sa_key": _sa_keys,
    "J9_esp_ah_same_sa": _dual_packets,
    "U1_intersect_sa_keys": _dual_sas,
    "J15_message_with_proposals": _messages_with_proposals,
    "W3_replay_scan": _anomalies,
    "W3_replay_scan_long_sa": _long_sa,
    "L6_anomaly_cap": _capped,
    **{name: _rule(rule_id) for name, rule_id in _RULE_KEYS.items()},
    "A27_evidence_digest": _chunks,
    "U2_rule_union": lambda s, d: finding_table(s, d).select(*SHOWN),
    "J10_new_findings": _fresh,
    "A28_assessment_run": _summary,
    "A29_severity_rollup": _severities,
    "W8_finding_numbers": _numbered,
    "L3_findings_newest_first": _newest_findings,
}

# ---- DuckDB side ---------------------------------------------------------------------------
_PROPOSAL_TAIL = PROPOSALS_SQL.replace(PACKETS_SQL, "")
_COUNTED_TAIL = COUNTED_SQL.replace(PACKETS_SQL, "")
TABLES_SQL = FLOWS_SQL + _PROPOSAL_TAIL + _COUNTED_TAIL + """,
ipsec as (
  select fp.capture_id, packet_id, fp.protocol, fp.spi, sequence_number,
    case when se = hs and de = hd then 'upstream' else 'downstream' end as direction
  from fp join head h using (capture_id, flow_pair) where fp.protocol in ('esp', 'ah'))"""


def _replay_sql(spi: str) -> str:
    return f""",
seqs as (
  select capture_id, concat(protocol, '_packets') as source_table, {spi} as spi, direction, packet_id,
    sequence_number, min(packet_id) over w as sa_first_id,
    row_number() over (w order by packet_id) as rn
  from ipsec window w as (partition by capture_id, protocol, {spi}, direction)),
walk as (
  select *, sequence_number as m, false as anomaly from seqs where rn = 1
  union all
  select s.*, case when w.m - s.sequence_number > 2147483648 or s.sequence_number > w.m
      then s.sequence_number else w.m end,
    not (w.m - s.sequence_number > 2147483648 or s.sequence_number > w.m)
  from walk w join seqs s on s.capture_id = w.capture_id and s.source_table = w.source_table
    and s.spi = w.spi and s.direction = w.direction and s.rn = w.rn + 1),
anomaly as (select capture_id, source_table, spi, direction, packet_id, sequence_number, sa_first_id
  from walk where anomaly)"""


_CAPPED_SQL = """,
capped as (
  select *, row_number() over (partition by capture_id, source_table
    order by sa_first_id, spi, direction, packet_id) as position from anomaly)"""

_UNKNOWN = "(encryption is null or encryption in ('UNKNOWN', 'unknown', '') or encryption like 'ENCR\\_%' escape '\\')"
_SIZED = ", ".join(f"'{n}'" for n in dims.SIZED_AES)
_WEAK = (
    f"case when encryption in ({_SIZED}) then case when key_length < 128 then 'high' end else case encryption "
    + " ".join(f"when '{k}' then '{v}'" for k, v in dims.WEAK_ENCRYPTION.items())
    + " end end"
)
_WEAK_DH = "case when dh_group in (1, 2, 22) then 'high' when dh_group = 3 then 'medium' end"
_GROUP_NAMES = "case dh_group " + " ".join(f"when {k} then '{v}'" for k, v in dims.DH_GROUPS.items()) + " end"


def _unresolved_sql(column: str) -> str:
    prefixed = " or ".join(f"starts_with({column}, '{p}')" for p in dims.UNRESOLVED_PREFIXES)
    return f"({column} is null or {column} in ('UNKNOWN', 'unknown', '') or {prefixed})"


def _in(names: tuple[str, ...]) -> str:
    return "exchange_name in (" + ", ".join(f"'{n}'" for n in names) + ")"


_SETUP, _PROGRESS = _in(dims.SETUP_EXCHANGES), _in(dims.PROGRESS_EXCHANGES)
_CHILD = _in(dims.CHILD_EXCHANGES)
_NOT_PLAIN = ", ".join(f"'{p}'" for p in (*dims.IPSEC_PROTOCOLS, *dims.CARRIER_PROTOCOLS))


def _item(source: str, field: str, observed: str, expected: str, status: str, note: str,
          shown: str, confidence: str, severity: str, kind: str, key: str) -> str:
    return (
        f"select capture_id, cast({key} as varchar) as group_key, {severity} as severity, "
        f"'{kind}' as finding_type, {confidence} as confidence, {source} as item_source, "
        f"'{field}' as item_field, cast({observed} as varchar) as item_observed, "
        f"'{expected}' as item_expected, '{status}' as observation_status, {note} as note, "
        f"{shown} as observed_value"
    )


_V = "vulnerability_indicator"
_CONFLICTS = """(select capture_id, protocol_name, initiator_spi, responder_spi from prop
  where status = 'SELECTED' group by 1, 2, 3, 4 having count(*) > 1)"""
_DUAL = """(select capture_id, spi, direction from ipsec group by 1, 2, 3
  having count(distinct protocol) = 2)"""
_PFS = f"""(select capture_id, count(*) as n from msg where {_CHILD} group by 1
  having not bool_or(has_ke) and capture_id not in (select capture_id from prop
    where {_CHILD} and dh_group is not null))"""
_OPEN = f"""(select capture_id, count(*) filter ({_SETUP}) as n from msg group by 1
  having count(*) filter ({_SETUP}) > 0 and not bool_or({_PROGRESS})
    and capture_id in (select capture_id from ipsec))"""
_FREQUENT = f"""(select capture_id, source_ip, destination_ip, count(*) as n from msg where {_SETUP}
  group by 1, 2, 3 having count(*) >= 20)"""

# rule -> (heads, references)
RULE_SQL = {
    "IPSEC-CRYPTO-001": (
        _item("'esp_packets'", "encryption_algorithm", "'UNKNOWN'", rules.VERIFIABLE, "observed",
              "concat(count(*), ' ESP packet(s) recorded without a verifiable encryption algorithm"
              " (payloads are not decrypted).')",
              "'UNKNOWN'", "'high'", "'low'", "informational", "'esp'")
        + " from ipsec where protocol = 'esp' group by capture_id union all "
        + _item("'ike_proposals'", "encryption",
                "string_agg(distinct encryption, ', ' order by encryption)", rules.VERIFIABLE, "observed",
                "concat(count(*), ' IKE proposal(s) reference an unrecognized encryption transform id.')",
                "string_agg(distinct encryption, ', ' order by encryption)", "'high'", "'low'",
                "informational", "'proposals'")
        + f" from prop where {_UNKNOWN} group by capture_id",
        "select capture_id, 'esp' as group_key, 'packet' as kind, packet_id from ipsec where protocol = 'esp'"
        f" union all select capture_id, 'proposals', 'message', packet_id from prop where {_UNKNOWN}",
    ),
    "IPSEC-CRYPTO-002": (
        _item("'ike_proposals'", "encryption", "o", rules.STRONG_ENCRYPTION, "observed",
              "concat(count(*), ' proposal(s) affected.')", "o",
              "case when bool_or(transform_confidence = 'high') then 'high' else 'medium' end",
              "max(w)", _V, "o")
        + f" from (select *, concat_ws('/', encryption, cast(key_length as varchar)) as o, {_WEAK} as w"
        " from prop) where w is not null group by capture_id, o",
        f"select capture_id, concat_ws('/', encryption, cast(key_length as varchar)) as group_key,"
        f" 'message' as kind, packet_id from prop where {_WEAK} is not null",
    ),
    "IPSEC-DH-001": (
        _item("'ike_proposals'", "dh_group", "dh_group", rules.STRONG_DH, "observed",
              "concat(count(*), ' proposal(s) affected.')",
              f"concat('DH group ', dh_group, ' (', {_GROUP_NAMES}, ')')", "'high'", f"{_WEAK_DH}", _V,
              "dh_group")
        + f" from prop where {_WEAK_DH} is not null group by capture_id, dh_group",
        f"select capture_id, cast(dh_group as varchar) as group_key, 'message' as kind, packet_id"
        f" from prop where {_WEAK_DH} is not null",
    ),
    "IPSEC-PFS-001": (
        _item("'ike_messages'", "payload_types", "'SA (no KE)'", "SA + KE (fresh DH on rekey)", "observed",
              "concat(n, ' child-SA exchange(s) without a DH/KE payload.')",
              "'no KE / new DH on child rekey'", "'high'", "'medium'", "policy_deviation", "'child'")
        + f" from {_PFS}",
        f"select capture_id, 'child' as group_key, k.kind, packet_id from msg, (values ('message'), ('packet'))"
        f" as k(kind) where {_CHILD} and capture_id in (select capture_id from {_PFS})",
    ),
    "IPSEC-IKE-001": (
        _item("'ike_messages'", "exchange_name", "'IKE_SA_INIT only'",
              "IKE_SA_INIT then IKE_AUTH / CREATE_CHILD_SA", "inferred",
              "concat(n, ' setup exchange(s) without a later-stage message; ESP/AH traffic present in"
              " the same capture.')", "'IKE_SA_INIT only (+ ESP/AH)'", "'medium'", "'low'",
              "configuration_risk", "'setup'")
        + f" from {_OPEN}",
        f"select capture_id, 'setup' as group_key, k.kind, packet_id from msg, (values ('message'), ('packet'))"
        f" as k(kind) where {_SETUP} and capture_id in (select capture_id from {_OPEN})",
    ),
    "IPSEC-SA-001": (
        _item("'ike_proposals'", "transform_confidence", "'unresolved integrity/PRF'",
              "resolved transform values", "observed",
              "concat(count(*), ' selected proposal(s) contain unresolved transform attributes.')",
              "concat(count(*), ' unresolved selected proposal(s)')", "'medium'", "'medium'",
              "configuration_risk", "'unresolved'")
        + f" from prop where status = 'SELECTED' and ({_unresolved_sql('integrity')} or"
        f" {_unresolved_sql('prf')}) group by capture_id union all "
        + _item("'ike_proposals'", "status", "'multiple SELECTED proposals per SA'",
                "exactly one SELECTED proposal per SA", "inferred",
                "concat(count(*), ' SA(s) with conflicting selections.')",
                "'conflicting SELECTED proposals'", "'low'", "'high'", _V, "'conflicting'")
        + f" from {_CONFLICTS} group by capture_id",
        f"select capture_id, 'unresolved' as group_key, 'message' as kind, packet_id from prop where"
        f" status = 'SELECTED' and ({_unresolved_sql('integrity')} or {_unresolved_sql('prf')})"
        f" union all select capture_id, 'conflicting', 'message', packet_id from prop semi join {_CONFLICTS}"
        " using (capture_id, protocol_name, initiator_spi, responder_spi) where status = 'SELECTED'",
    ),
    "IPSEC-REPLAY-001": (
        _item("source_table", "sequence_number",
              "string_agg(sequence_number, ', ' order by position) filter (position <= 5)",
              "strictly increasing per (SPI, direction)", "inferred",
              "concat(count(*), ' non-increasing sequence observation(s); out-of-order delivery cannot"
              " be excluded.')", "concat(count(*), ' non-increasing sequence(s)')", "'medium'",
              "'medium'", _V, "source_table")
        + " from capped group by capture_id, source_table",
        "select capture_id, source_table as group_key, 'packet' as kind, packet_id from capped",
    ),
    "IPSEC-COMPOSITE-001": (
        _item("'ah_packets'", "spi",
              "string_agg(concat(spi, '/', direction), ', ' order by concat(spi, '/', direction))",
              "no SPI shared with ESP", "observed", "concat(count(*), ' SA(s) carry both ESP and AH.')",
              "concat(count(*), ' SA(s) with ESP + AH')", "'high'", "'info'", "informational", "'shared'")
        + f" from {_DUAL} group by capture_id",
        f"select capture_id, 'shared' as group_key, 'packet' as kind, packet_id from ipsec semi join {_DUAL}"
        " using (capture_id, spi, direction) where protocol = 'esp'",
    ),
    "IPSEC-META-001": (
        _item("'protocol_observations'", "protocol", "string_agg(protocol, ', ' order by protocol)",
              "IPsec protocols only", "observed",
              "concat('Plaintext protocols with packet counts: ', string_agg(concat(protocol, '=',"
              " packet_count), ', ' order by protocol))",
              "string_agg(protocol, ', ' order by protocol)", "'high'", "'info'", "informational",
              "'plaintext'")
        + f" from obs where protocol not in ({_NOT_PLAIN}) and capture_id in (select capture_id from"
        " verdicts where parsed) group by capture_id",
        "select capture_id, 'plaintext' as group_key, 'packet' as kind, packet_id from msg where false",
    ),
    "IPSEC-META-002": (
        _item("'ike_messages'", "exchange_name", "concat(n, ' setup requests')", "< 20 setup requests",
              "inferred", "concat(n, ' initiations from ', source_ip, ' to ', destination_ip,"
              " '; threshold is 20 setup requests from one endpoint.')",
              "concat(n, ' initiations from ', source_ip, ' to ', destination_ip)", "'medium'", "'info'",
              "informational", "concat(source_ip, '>', destination_ip)")
        + f" from {_FREQUENT}",
        f"select capture_id, concat(source_ip, '>', destination_ip) as group_key, 'message' as kind,"
        f" packet_id from msg semi join {_FREQUENT} using (capture_id, source_ip, destination_ip)"
        f" where {_SETUP}",
    ),
}


def _assembled(rule_ids: list[str]) -> str:
    """CTEs ``ck`` (evidence chunks) and ``found`` (findings with digests) of the given rules."""
    heads = " union all ".join(
        f"select '{rule}' as rule_id, * from ({RULE_SQL[rule][0]})" for rule in rule_ids
    )
    refs = " union all ".join(
        f"select '{rule}' as rule_id, * from ({RULE_SQL[rule][1]})" for rule in rule_ids
    )
    return TABLES_SQL + _replay_sql("spi") + _CAPPED_SQL + f""",
heads as ({heads}),
refs as ({refs}),
ck as (
  select *, sha256(array_to_string(ids, ',')) as chunk_digest from (
    select capture_id, rule_id, group_key, kind, cast(packet_id // 10000 as bigint) as chunk,
      list_sort(list(distinct packet_id)) as ids from refs group by 1, 2, 3, 4, 5)),
dg as (
  select capture_id, rule_id, group_key,
    cast(coalesce(sum(len(ids)) filter (kind = 'packet'), 0) as bigint) as packet_refs,
    cast(coalesce(sum(len(ids)) filter (kind = 'message'), 0) as bigint) as message_refs,
    string_agg(concat(kind, ':', lpad(cast(chunk as varchar), 12, '0'), ':', chunk_digest), '|'
      order by concat(kind, ':', lpad(cast(chunk as varchar), 12, '0'), ':', chunk_digest)) as rd
  from ck group by 1, 2, 3),
found as (
  select h.*, coalesce(packet_refs, 0) as packet_refs, coalesce(message_refs, 0) as message_refs,
    sha256(concat_ws('|', item_source, item_field, item_observed, item_expected, observation_status,
      coalesce(rd, ''))) as evidence_digest
  from heads h left join dg using (capture_id, rule_id, group_key))"""


_ALL = _assembled(list(RULE_SQL))
_SHOWN = ", ".join(SHOWN)
_RULE_VALUES = ", ".join(f"('{rule}')" for rule in RULE_SQL)
_OLD = "cast(substr(capture_id, 5) as int) % 2 = 0"

ORACLES = {
    "F3_unknown_value": PROPOSALS_SQL
    + f" select capture_id, count(*) filter ({_UNKNOWN}) as unknown_encryption, count(*) filter"
    " (encryption is null or encryption in ('UNKNOWN', 'unknown', '')) as unknown_value"
    " from prop group by 1",
    "F4_unresolved_transform": PROPOSALS_SQL
    + f" select capture_id, status, count(*) filter ({_unresolved_sql('integrity')}) as"
    f" integrity_unresolved, count(*) filter ({_unresolved_sql('prf')}) as prf_unresolved"
    " from prop group by 1, 2",
    "F5_weak_encryption": PROPOSALS_SQL
    + f" select encryption, key_length, {_WEAK} as severity, count(*) as n from prop"
    f" where {_WEAK} is not null group by 1, 2, 3",
    "F6_weak_dh": PROPOSALS_SQL
    + f" select dh_group, {_WEAK_DH} as severity, count(*) as n from prop where {_WEAK_DH} is not null"
    " group by 1, 2",
    "F7_exchange_sets": PROPOSALS_SQL
    + f" select capture_id, count(*) filter ({_SETUP}) as setup, count(*) filter ({_PROGRESS}) as"
    f" progress, count(*) filter ({_CHILD}) as child from msg group by 1",
    "F8_plaintext_protocols": COUNTED_SQL
    + f" select capture_id, protocol, packet_count from obs where protocol not in ({_NOT_PLAIN})",
    "P18_code_names": PROPOSALS_SQL
    + f" select dh_group, {_GROUP_NAMES} as name, count(*) as n from prop where dh_group is not null"
    " group by 1",
    "J7_child_proposals": PROPOSALS_SQL
    + f" select ike_message_id, proposal_number, dh_group from prop where {_CHILD}",
    "J8_proposal_sa_key": PROPOSALS_SQL
    + " select capture_id, protocol_name, concat(initiator_spi, ':', responder_spi) as sa_key,"
    " count(*) as selections from prop where status = 'SELECTED' group by 1, 2, 3 having count(*) > 1",
    "J9_esp_ah_same_sa": TABLES_SQL
    + f" select capture_id, spi, direction, packet_id from ipsec semi join {_DUAL}"
    " using (capture_id, spi, direction) where protocol = 'esp'",
    "U1_intersect_sa_keys": TABLES_SQL
    + " select capture_id, spi, direction from ipsec where protocol = 'esp' intersect"
    " select capture_id, spi, direction from ipsec where protocol = 'ah'",
    "J15_message_with_proposals": PROPOSALS_SQL
    + """ select m.ike_message_id, count(p.proposal_number) as proposal_count,
      coalesce(string_agg(p.encryption, ',' order by p.proposal_number, p.protocol_name,
        p.encryption), '') as encryptions
      from msg m left join prop p using (ike_message_id) group by 1""",
    "W3_replay_scan": TABLES_SQL + _replay_sql("spi") + " select * from anomaly",
    "W3_replay_scan_long_sa": TABLES_SQL + _replay_sql("'all'") + " select * from anomaly",
    "L6_anomaly_cap": TABLES_SQL + _replay_sql("'all'") + _CAPPED_SQL
    + " select capture_id, source_table, position, packet_id, sequence_number from capped"
    " where position <= 25",
    **{
        name: _assembled([rule_id]) + f" select {_SHOWN} from found"
        for name, rule_id in _RULE_KEYS.items()
    },
    "A27_evidence_digest": _ALL
    + " select capture_id, rule_id, group_key, kind, chunk, len(ids) as cited, chunk_digest from ck",
    "U2_rule_union": _ALL + f" select {_SHOWN} from found",
    "J10_new_findings": _ALL
    + f" select capture_id, rule_id, group_key, evidence_digest from found where not ({_OLD})",
    "A28_assessment_run": _ALL
    + f""" select r.rule_id, '1.0.0' as rule_version, count(f.rule_id) filter (not ({_OLD})) as created,
      count(f.rule_id) filter ({_OLD}) as skipped
      from (values {_RULE_VALUES}) r(rule_id) left join found f using (rule_id) group by 1""",
    "A29_severity_rollup": _ALL
    + " select capture_id, count(*) as total, "
    + ", ".join(
        f"count(*) filter (severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low", "info")
    )
    + " from found group by 1",
    "W8_finding_numbers": _ALL
    + " select concat('SEC-', lpad(cast(row_number() over (order by evidence_digest, capture_id,"
    " rule_id) as varchar), 6, '0')) as finding_id, evidence_digest, capture_id from found",
    "L3_findings_newest_first": _ALL
    + " select cast(concat('0x', substr(evidence_digest, 1, 8)) as bigint) as created_at, rule_id,"
    " capture_id from found order by 1 desc, evidence_digest",
}
