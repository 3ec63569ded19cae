"""Frames to packets, IKE messages and ESP/AH records.

Every field is a native expression over the frame's BINARY column; the variable-length walks
(IPv6 extension headers, IKE payload chain, proposals) are bounded folds. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.binary import expand, hex_text, part, size, uint
from flowlens.operators.dims import IKEV1_EXCHANGES, IKEV2_EXCHANGES, lookup_sql
from flowlens.operators.flows import orient
from flowlens.operators.ike import (
    fold,
    payload_walk,
    proposal_bodies,
    v1_proposal,
    v1_transforms,
    v2_proposal,
    v2_transforms,
)

# ---- fixed values: protocol numbers, ether types, ports and evidence texts ----------------
ICMP, TCP, UDP, ESP, AH, ICMPV6 = 1, 6, 17, 50, 51, 58
ETHER_IPV4, ETHER_IPV6, ETHER_VLAN, ETHER_QINQ = 0x0800, 0x86DD, 0x8100, 0x88A8
IPV6_EXTENSIONS = (0, 43, 60, 135, 44)
IPV6_FRAGMENT = 44
IKE_PORT, NATT_PORT, IKE_HEADER = 500, 4500, 28
INITIATOR_MASK = 0x01
TEXT_FRAGMENT_PORTS = "IP fragment — transport ports not dissected"
TEXT_FRAGMENT = "IP fragment — transport not dissected"
TEXT_NATT_IKE = "NAT-T IKE (non-ESP marker present)"
TEXT_NATT_ESP = "ESP over UDP 4500 (NAT-T)"
TEXT_ESP = "ESP header parsed (protocol 50)"
TEXT_AH = "AH header parsed (protocol 51)"

_IPV6_HEADER_BYTES = 8
_EXTENSION_LIST = ", ".join(str(code) for code in IPV6_EXTENSIONS)


def strip_link_layer(frames: DataFrame) -> DataFrame:
    """Adds ``l3``, the offset of the IP header; frames without one are dropped.

    Ethernet II, one VLAN or QinQ tag, else raw IP by the first nibble. Inherited limits: only one
    tag is removed, and a non-IP Ethernet frame whose first address nibble is 4 or 6 is read as
    raw IP.
    """
    length, ether, nibble = size("data"), uint("data", 12, 2), f"shiftright({uint('data', 0, 1)}, 4)"
    offset = f"""case
        when {length} >= 18 and {ether} in ({ETHER_VLAN}, {ETHER_QINQ}) then 18
        when {length} >= 14 and {ether} in ({ETHER_IPV4}, {ETHER_IPV6}) then 14
        when {length} >= 14 and {nibble} in (4, 6) then 0 end"""
    return expand(frames, frames.columns, f"named_struct('l3', {offset})", "x.l3 is not null")


def _ipv6_walk() -> str:
    """Follow extension headers from ``body`` to the transport header."""
    following, fragment = uint("data", "s.offset", 1), f"s.next = {IPV6_FRAGMENT}"
    header = f"({uint('data', 's.offset + 1', 1)} + 1) * 8"
    malformed = f"s.offset + 2 > body_end or (not {fragment} and s.offset + {header} > body_end)"
    advanced = (
        f"named_struct('next', {following}, "
        f"'offset', s.offset + case when {fragment} then 8 else {header} end, "
        f"'fragmented', s.fragmented or {fragment}, 'failed', false, "
        f"'done', {following} not in ({_EXTENSION_LIST}))"
    )
    broken = (
        "named_struct('next', s.next, 'offset', s.offset, 'fragmented', s.fragmented, "
        "'failed', true, 'done', true)"
    )
    initial = (
        "named_struct('next', proto, 'offset', body, 'fragmented', false, 'failed', false, "
        "'done', false)"
    )
    step = f"case when {malformed} then {broken} else {advanced} end"
    return fold("data", _IPV6_HEADER_BYTES, initial, step)


def parse_ip(frames: DataFrame) -> DataFrame:
    """IP version, addresses, protocol number, transport range ``[body, body_end)``, fragment flag.

    IPv4 trims link padding by the total length (0 means "whole frame"); IPv6 by the payload
    length. Malformed headers drop the row.
    """
    available = f"({size('data')} - l3)"
    first = uint("data", "l3", 1)
    version, header = f"shiftright({first}, 4)", f"(({first} & 15) * 4)"
    total, payload = uint("data", "l3 + 2", 2), uint("data", "l3 + 4", 2)
    end4 = f"case when {total} > 0 then least({total}, {available}) else {available} end"
    end6 = f"case when {payload} > 0 then least({payload} + 40, {available}) else {available} end"
    outer = f"""case
        when {version} = 4 and {available} >= 20 and {header} >= 20 and {header} <= {available}
        then named_struct('ip_version', 4, 'proto', {uint("data", "l3 + 9", 1)},
            'body', l3 + {header}, 'body_end', l3 + {end4},
            'fragmented', ({uint("data", "l3 + 6", 2)} & 16383) > 0)
        when {version} = 6 and {available} >= 40
        then named_struct('ip_version', 6, 'proto', {uint("data", "l3 + 6", 1)},
            'body', cast(l3 + 40 as bigint), 'body_end', l3 + {end6}, 'fragmented', false)
        end"""
    headers = expand(frames, frames.columns, outer, "x is not null")
    walk = f"""case when ip_version = 6 and proto in ({_EXTENSION_LIST}) then {_ipv6_walk()}
        else named_struct('next', proto, 'offset', body, 'fragmented', fragmented,
            'failed', false, 'done', true) end"""
    kept = [*frames.columns, "ip_version", "body_end"]
    walked = expand(headers, kept, walk, "x.done and not x.failed")
    dotted = ["concat_ws('.', " + ", ".join(uint("data", f"l3 + {at + i}", 1) for i in range(4)) + ")" for at in (12, 16)]
    groups = [
        f"regexp_replace({hex_text('data', f'l3 + {at}', 16)}, '(.{{4}})(?!$)', '$1:')" for at in (8, 24)
    ]
    return walked.selectExpr(
        *[c for c in frames.columns if c != "l3"],
        "ip_version",
        f"case when ip_version = 6 then {groups[0]} else {dotted[0]} end as source",
        f"case when ip_version = 6 then {groups[1]} else {dotted[1]} end as destination",
        "next as proto",
        "offset as body",
        "body_end",
        "greatest(body_end - offset, 0L) as room",
        "fragmented",
    )


def _ports(ip: DataFrame) -> DataFrame:
    """Ports and the kind of IPsec content. Port 500 is tested before port 4500."""
    has_ports = f"not fragmented and ((proto = {UDP} and room >= 8) or (proto = {TCP} and room >= 20))"
    ported = ip.selectExpr(
        "*",
        f"case when {has_ports} then cast({uint('data', 'body', 2)} as int) end as source_port",
        f"case when {has_ports} then cast({uint('data', 'body + 2', 2)} as int) end as destination_port",
    )
    datagram = f"source_port is not null and proto = {UDP}"
    on_ike = f"(source_port = {IKE_PORT} or destination_port = {IKE_PORT})"
    on_natt = f"(source_port = {NATT_PORT} or destination_port = {NATT_PORT})"
    marker = f"(room >= 12 and {uint('data', 'body + 8', 4)} = 0)"
    return ported.selectExpr(
        "*",
        f"""case when {datagram} and {on_ike} then 'ike'
            when {datagram} and {on_natt} and {marker} then 'natt_ike'
            when {datagram} and {on_natt} and room >= 16 then 'natt_esp'
            when proto = {ESP} and not fragmented and room >= 8 then 'esp'
            when proto = {AH} and not fragmented and room >= 12 then 'ah' end as kind""",
    ).selectExpr(
        "*",
        "case kind when 'ike' then body + 8 when 'natt_ike' then body + 12 "
        "when 'natt_esp' then body + 8 when 'esp' then body end as at",
    )


def _ike_columns() -> tuple[str, str]:
    """The walked payload chain, and the IKE layer built from it (NULL below 28 bytes)."""
    major = f"shiftright({uint('data', 'at + 17', 1)}, 4)"
    version = f"case {major} when 2 then 'IKEv2' when 1 then 'IKEv1' else 'unknown' end"
    body = part("data", f"at + {IKE_HEADER}", f"body_end - at - {IKE_HEADER}")
    chain = (
        f"case when kind in ('ike', 'natt_ike') and body_end - at >= {IKE_HEADER} "
        f"then {payload_walk(body, uint('data', 'at + 16', 1), version)} end"
    )
    exchange = uint("data", "at + 18", 1)
    named = (
        f"case when {major} = 2 then {lookup_sql(IKEV2_EXCHANGES, exchange)} "
        f"else {lookup_sql(IKEV1_EXCHANGES, exchange)} end"
    )
    layer = f"""case when chain is not null then named_struct(
        'version', {version},
        'initiator_spi', {hex_text("data", "at", 8)},
        'responder_spi', {hex_text("data", "at + 8", 8)},
        'next_payload', cast({uint("data", "at + 16", 1)} as int),
        'exchange_type', cast({exchange} as int),
        'exchange_name', coalesce({named}, concat('EXCHANGE_', cast({exchange} as string))),
        'flags', cast({uint("data", "at + 19", 1)} as int),
        'message_id', {hex_text("data", "at + 20", 4)},
        'length', {uint("data", "at + 24", 4)},
        'payload_types', chain.names,
        'sa_payload', chain.sa_payload) end"""
    return chain, layer


def decode_packets(frames: DataFrame) -> DataFrame:
    """Frames (capture_id, frame_number, ts, data) to packets with nested IKE/ESP/AH layers.

    ``length`` is the captured length; the wire length stays in the frames' ``orig_length``.
    """
    chain, layer = _ike_columns()
    kinds = _ports(parse_ip(strip_link_layer(frames))).selectExpr("*", f"{chain} as chain")
    ports = f"proto in ({UDP}, {TCP})"
    return kinds.selectExpr(
        "capture_id",
        "frame_number as packet_id",
        "ts",
        f"{size('data')} as length",
        "source",
        "destination",
        "ip_version",
        f"""case when kind in ('natt_esp', 'esp') then 'esp' when kind = 'ah' then 'ah'
            when proto = {UDP} and (fragmented or room > 0) then 'udp'
            when proto = {TCP} and (fragmented or room > 0) then 'tcp'
            when proto = {ICMP} then 'icmp' when proto = {ICMPV6} then 'icmpv6'
            else 'unknown' end as protocol""",
        f"""case when {ports} and (fragmented or source_port is not null)
            then if(proto = {UDP}, 'udp', 'tcp') end as transport""",
        "source_port",
        "destination_port",
        "fragmented",
        f"{layer} as ike",
        f"""case when kind in ('natt_esp', 'esp') then named_struct(
            'spi', {hex_text("data", "at", 4)}, 'sequence_number', {uint("data", "at + 4", 4)},
            'encryption_algorithm', 'UNKNOWN', 'nat_t', kind = 'natt_esp') end as esp""",
        f"""case when kind = 'ah' then named_struct(
            'spi', {hex_text("data", "body + 4", 4)}, 'sequence_number', {uint("data", "body + 8", 4)},
            'next_header', cast({uint("data", "body", 1)} as int)) end as ah""",
        f"""array_compact(array(case when fragmented and {ports} then '{TEXT_FRAGMENT_PORTS}'
            when kind = 'ike' and chain is not null then concat('IKE header parsed (',
                case shiftright({uint("data", "at + 17", 1)}, 4)
                    when 2 then 'IKEv2' when 1 then 'IKEv1' else 'unknown' end, ')')
            when kind = 'natt_ike' and chain is not null then '{TEXT_NATT_IKE}'
            when kind = 'natt_esp' then '{TEXT_NATT_ESP}'
            when kind = 'esp' then '{TEXT_ESP}' when kind = 'ah' then '{TEXT_AH}'
            when fragmented and proto not in ({ICMP}, {ICMPV6}) then '{TEXT_FRAGMENT}'
            end)) as evidence""",
    )


def ike_messages(packets: DataFrame, initiator_mask: int = INITIATOR_MASK) -> DataFrame:
    """One row per packet with an IKE layer.

    The role comes from flag bit 0x01 by default, as existing results do; RFC 7296 defines 0x08,
    which ``initiator_mask=0x08`` selects. IKEv1 carries no role.
    """
    starts = f"(ike.flags & {initiator_mask}) <> 0"
    return packets.where("ike is not null").selectExpr(
        "capture_id",
        "concat(capture_id, ':', packet_id) as ike_message_id",
        "packet_id",
        "ts",
        "source as source_ip",
        "destination as destination_ip",
        "coalesce(source_port, 0) as source_port",
        "coalesce(destination_port, 0) as destination_port",
        "ike.*",
        f"""case when ike.version <> 'IKEv2' then 'unknown' when {starts} then 'initiator'
            else 'responder' end as direction""",
        f"if(ike.version = 'IKEv2' and not {starts}, 'SELECTED', 'OFFERED') as proposal_status",
    )


def ike_proposals(
    messages: DataFrame, v1_attribute_offset: int = 4, v1_skip_doi: bool = False
) -> DataFrame:
    """One row per crypto proposal of the messages' SA payloads."""
    bodies = messages.where("sa_payload is not null").selectExpr(
        "capture_id",
        "ike_message_id",
        "packet_id",
        "version",
        "proposal_status as status",
        f"explode({proposal_bodies('sa_payload', 'version', v1_skip_doi)}) as body",
    )
    transforms = (
        f"named_struct('v2', case when version = 'IKEv2' then {v2_transforms('body')} end, "
        f"'v1', case when version <> 'IKEv2' then {v1_transforms('body', v1_attribute_offset)} end)"
    )
    split = expand(bodies, bodies.columns, transforms, "true")
    second, first = v2_proposal("body", "v2"), v1_proposal("body", "v1")
    kinds = {"encryption_id": "int", "integrity_id": "int", "prf_id": "int", "dh_group": "int", "esn": "int"}
    return split.selectExpr(
        "capture_id",
        "ike_message_id",
        "packet_id",
        f"cast({uint('body', 0, 1)} as int) as proposal_number",
        f"cast({uint('body', 1, 1)} as int) as protocol_id",
        *[
            f"cast(if(version = 'IKEv2', {second[c]}, {first[c]}) as "
            f"{kinds.get(c, 'bigint' if c == 'key_length' else 'string')}) as {c}"
            for c in second
        ],
        "status",
    )


def _records(packets: DataFrame, flows: DataFrame, layer: str, extra: str) -> DataFrame:
    return orient(packets.where(F.col(layer).isNotNull()), flows).select(
        "capture_id",
        "packet_id",
        "ts",
        F.col("source").alias("source_ip"),
        F.col("destination").alias("destination_ip"),
        f"{layer}.spi",
        f"{layer}.sequence_number",
        "length",
        "direction",
        "flow_key",
        f"{layer}.{extra}",
    )


def esp_packets(packets: DataFrame, flows: DataFrame) -> DataFrame:
    return _records(packets, flows, "esp", "encryption_algorithm")


def ah_packets(packets: DataFrame, flows: DataFrame) -> DataFrame:
    return _records(packets, flows, "ah", "next_header")
