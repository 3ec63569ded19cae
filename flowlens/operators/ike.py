"""IKE payload chains, SA proposals, transforms and attributes as bounded native folds.

All functions return Spark SQL text over BINARY expressions.
"""

from __future__ import annotations

from flowlens.functions.binary import let, part, size, uint
from flowlens.operators.dims import (
    ENCRYPTION,
    IKEV1_AUTH,
    IKEV1_CIPHER_TRANSFORMS,
    IKEV1_ENCRYPTION,
    IKEV1_HASH,
    IKEV1_PAYLOADS,
    IKEV1_PROTOCOLS,
    IKEV2_PAYLOADS,
    IKEV2_PROTOCOLS,
    INTEGRITY,
    PRF,
    lookup_sql,
    name_or_code_sql,
)

# ---- fixed values: payload numbers, attribute numbers -------------------------------------
PAYLOAD_SA_V2, PAYLOAD_SA_V1, PAYLOAD_SK = 33, 1, 46
ATTR_KEY_LENGTH = 14
KEY_IKE, ATTR_PHASE1_CIPHER = 1, 1
V1_GROUP, V1_KEY, V1_AUTH, V1_HASH, V1_KEY_ISAKMP = 3, 4, 5, 6, 11

#: payloads, proposals, transforms and attributes take four bytes at least
_STEP_BYTES = 4


def fold(data: str, step_bytes: int, initial: str, step: str) -> str:
    """Apply ``step`` (text over ``s``) while ``s.done`` is false.

    Every step takes ``step_bytes`` or more of ``data``, so its size bounds their number.
    """
    most = f"cast(coalesce({size(data)}, 0) div {step_bytes} + 1 as int)"
    return (
        f"aggregate(sequence(1, {most}), {initial}, "
        f"(s, i) -> case when s.done then s else {step} end)"
    )


def payload_name(version: str, code: str) -> str:
    named = (
        f"case when {version} = 'IKEv2' then {lookup_sql(IKEV2_PAYLOADS, code)} "
        f"else {lookup_sql(IKEV1_PAYLOADS, code)} end"
    )
    return f"coalesce({named}, concat('PAYLOAD_', cast({code} as string)))"


def payload_walk(body: str, first: str, version: str) -> str:
    """Payload names and the body of the first SA payload, in one pass over the generic chain.

    Names stop on a length below 4 or after an encrypted payload. The SA body additionally needs
    every payload up to it to fit the message; once one overruns, no SA is taken.
    """
    sa_code = f"case when {version} = 'IKEv2' then {PAYLOAD_SA_V2} else {PAYLOAD_SA_V1} end"
    head = (
        f"named_struct('next', {uint('b', 's.offset', 1)}, 'length', {uint('b', 's.offset + 2', 2)})"
    )
    overrun = f"(s.overrun or s.offset + h.length > {size('b')})"
    is_sa = f"s.code = {sa_code} and h.length >= 4 and not {overrun} and s.sa_payload is null"
    initial = (
        f"named_struct('code', {first}, 'offset', 0L, 'names', cast(array() as array<string>), "
        f"'sa_payload', cast(null as binary), 'done', {first} = 0, 'overrun', false)"
    )
    seen = (
        "named_struct('code', h.next, 'offset', s.offset + h.length, "
        f"'names', concat(s.names, array({payload_name(version, 's.code')})), "
        f"'sa_payload', case when {is_sa} then {part('b', 's.offset + 4', 'h.length - 4')} "
        f"else s.sa_payload end, 'done', h.length < 4 or s.code = {PAYLOAD_SK} or h.next = 0, "
        f"'overrun', {overrun})"
    )
    stopped = (
        "named_struct('code', s.code, 'offset', s.offset, 'names', s.names, "
        "'sa_payload', s.sa_payload, 'done', true, 'overrun', s.overrun)"
    )
    step = f"case when s.offset + 4 > {size('b')} then {stopped} else {let('h', head, seen)} end"
    return let("b", body, fold("b", _STEP_BYTES, initial, step))


def substructures(data: str, start: str, chained: bool, limit: str | None = None) -> str:
    """Bodies of length-prefixed substructures (header byte 0, length at 2..4, body from 4).

    ``chained`` stops after a zero header byte, and all stop at ``limit`` bodies if one is given.
    """
    fits = (
        f"s.offset + 4 <= {size(data)} and length >= 4 "
        f"and s.offset + length <= {size(data)}"
        + (f" and size(s.bodies) < {limit}" if limit else "")
    )
    last = f"{uint(data, 's.offset', 1)} = 0" if chained else "false"
    initial = (
        f"named_struct('offset', cast({start} as bigint), "
        "'bodies', cast(array() as array<binary>), 'done', false)"
    )
    taken = (
        "named_struct('offset', s.offset + length, 'bodies', "
        f"concat(s.bodies, array({part(data, 's.offset + 4', 'length - 4')})), 'done', {last})"
    )
    stopped = "named_struct('offset', s.offset, 'bodies', s.bodies, 'done', true)"
    step = let(
        "length",
        uint(data, "s.offset + 2", 2),
        f"case when {fits} then {taken} else {stopped} end",
    )
    return f"{fold(data, _STEP_BYTES, initial, step)}.bodies"


def key_length_attribute(attributes: str) -> str:
    """First key-length attribute (type 14) of an IKEv2 transform, short or long form."""
    head = (
        f"named_struct('kind', {uint('a', 's.offset', 1)}, 'field', {uint('a', 's.offset + 2', 2)})"
    )
    wide = [uint("a", "s.offset + 4", width) for width in (2, 3, 4)]
    long_value = (
        f"coalesce(case when h.field >= 4 then {wide[2]} when h.field = 3 then {wide[1]} "
        f"else {wide[0]} end, 0L)"
    )
    found = f"((h.kind & 127) = {ATTR_KEY_LENGTH} and (h.kind >= 128 or h.field >= 2))"
    read = (
        "named_struct('offset', s.offset + case when h.kind >= 128 then 4 else h.field + 4 end, "
        f"'value', case when not {found} then null when h.kind >= 128 then h.field "
        f"else {long_value} end, 'done', {found})"
    )
    stopped = "named_struct('offset', s.offset, 'value', s.value, 'done', true)"
    initial = "named_struct('offset', 0L, 'value', cast(null as bigint), 'done', false)"
    step = f"case when s.offset + 4 <= {size('a')} then {let('h', head, read)} else {stopped} end"
    return f"{let('a', attributes, fold('a', _STEP_BYTES, initial, step))}.value"


def ikev1_attributes(data: str) -> str:
    """IKEv1 attributes as an array of (type, value); both forms are read as numbers.

    Values wider than 7 bytes (lifetimes, certificates) hold no number used here and read as NULL.
    """
    head = (
        f"named_struct('kind', {uint('d', 's.offset', 2)}, 'field', {uint('d', 's.offset + 2', 2)}, "
        f"'length', case when {uint('d', 's.offset', 2)} >= 32768 then 0 "
        f"else {uint('d', 's.offset + 2', 2)} end)"
    )
    number = (
        "case when h.kind >= 32768 then h.field when h.field between 1 and 7 then "
        f"cast(conv(hex({part('d', 's.offset + 4', 'h.field')}), 16, 10) as bigint) end"
    )
    read = (
        "named_struct('offset', s.offset + 4 + h.length, 'items', concat(s.items, "
        f"array(named_struct('type', h.kind & 32767, 'value', {number}))), 'done', false)"
    )
    stopped = "named_struct('offset', s.offset, 'items', s.items, 'done', true)"
    fits = f"s.offset + 4 <= {size('d')} and s.offset + 4 + h.length <= {size('d')}"
    initial = (
        "named_struct('offset', 0L, 'items', "
        "cast(array() as array<struct<type:bigint,value:bigint>>), 'done', false)"
    )
    step = let("h", head, f"case when {fits} then {read} else {stopped} end")
    return f"{let('d', data, fold('d', _STEP_BYTES, initial, step))}.items"


def _last(items: str, keep: str) -> str:
    """Last element satisfying ``keep`` (text over ``e``)."""
    return f"try_element_at(filter({items}, e -> {keep}), -1)"


def _attribute(items: str, code: int) -> str:
    return f"try_element_at(filter({items}, a -> a.type = {code}), -1).value"


def v2_transforms(body: str) -> str:
    """Transforms of an IKEv2 proposal body: array of (type, id, attributes).

    A transform of bare header length carries no type; the walk ends there and the row stays.
    """
    declared = uint(body, 3, 1)
    limit = f"case when {declared} > 0 then {declared} else {size(body)} end"
    bodies = substructures(body, f"4 + {uint(body, 2, 1)}", chained=False, limit=limit)
    return (
        f"transform(filter({bodies}, t -> {size('t')} >= 4), t -> named_struct("
        f"'type', {uint('t', 0, 1)}, 'id', {uint('t', 2, 2)}, "
        f"'attributes', {part('t', 4, size('t'))}))"
    )


def v1_transforms(body: str, attribute_offset: int) -> str:
    """Transforms of an IKEv1 proposal body: cipher, key length, hash, group, auth per transform.

    Phase-1 proposals name the exchange (KEY_IKE) as transform; their cipher is attribute 1.
    """
    spi_end = f"4 + {uint(body, 2, 1)}"
    start = f"case when {spi_end} <= {size(body)} then {spi_end} else 4 end"
    bodies = substructures(body, start, chained=False)
    raw = (
        f"transform(filter({bodies}, t -> {size('t')} >= 3), t -> named_struct("
        f"'id', {uint('t', 1, 1)}, 'attributes', "
        f"{ikev1_attributes(part('t', attribute_offset, size('t')))}))"
    )
    items = "r.attributes"
    phase1 = f"{uint(body, 1, 1)} = 1 and r.id = {KEY_IKE}"
    return (
        f"transform({raw}, r -> named_struct('cipher', case when {phase1} then "
        f"{_attribute(items, ATTR_PHASE1_CIPHER)} else r.id end, "
        f"'key_length', coalesce({_attribute(items, V1_KEY)}, {_attribute(items, V1_KEY_ISAKMP)}), "
        f"'hash', {_attribute(items, V1_HASH)}, 'dh', {_attribute(items, V1_GROUP)}, "
        f"'auth', {_attribute(items, V1_AUTH)}))"
    )


def v2_proposal(body: str, transforms: str) -> dict[str, str]:
    """Output columns of an IKEv2 proposal; the last transform of each type wins."""

    def last_id(kind: int) -> str:
        return f"{_last(transforms, f'e.type = {kind}')}.id"

    protocol = uint(body, 1, 1)
    return {
        "protocol_name": f"coalesce({lookup_sql(IKEV2_PROTOCOLS, protocol)}, 'UNKNOWN')",
        "encryption": f"coalesce({name_or_code_sql(ENCRYPTION, last_id(1), 'ENCR_')}, 'UNKNOWN')",
        "encryption_id": last_id(1),
        "key_length": key_length_attribute(f"{_last(transforms, 'e.type = 1')}.attributes"),
        "integrity": f"coalesce({name_or_code_sql(INTEGRITY, last_id(3), 'INTEG_')}, 'UNKNOWN')",
        "integrity_id": last_id(3),
        "prf": f"coalesce({name_or_code_sql(PRF, last_id(2), 'PRF_')}, 'UNKNOWN')",
        "prf_id": last_id(2),
        "dh_group": last_id(4),
        "esn": last_id(5),
        "transform_confidence": f"case when size({transforms}) > 0 then 'high' else 'low' end",
    }


def v1_proposal(body: str, transforms: str) -> dict[str, str]:
    """Output columns of an IKEv1 proposal; the authentication method is reported as ``prf``."""
    codes = ", ".join(str(code) for code in IKEV1_CIPHER_TRANSFORMS)
    cipher = f"{_last(transforms, f'e.cipher in ({codes})')}.cipher"
    keyed = _last(transforms, f"e.cipher in ({codes}) and e.key_length is not null")
    hash_id = f"{_last(transforms, 'e.hash is not null')}.hash"
    auth = f"{_last(transforms, 'e.auth is not null')}.auth"
    protocol = uint(body, 1, 1)
    return {
        "protocol_name": f"coalesce({lookup_sql(IKEV1_PROTOCOLS, protocol)}, 'UNKNOWN')",
        "encryption": f"coalesce({name_or_code_sql(IKEV1_ENCRYPTION, cipher, 'ALG_')}, 'UNKNOWN')",
        "encryption_id": cipher,
        "key_length": f"{keyed}.key_length",
        "integrity": f"coalesce({name_or_code_sql(IKEV1_HASH, hash_id, 'HASH_')}, 'UNKNOWN')",
        "integrity_id": hash_id,
        "prf": f"case when {auth} is null then 'UNKNOWN' "
        f"else coalesce({lookup_sql(IKEV1_AUTH, auth)}, 'AUTH_UNKNOWN') end",
        "prf_id": auth,
        "dh_group": f"{_last(transforms, 'e.dh is not null')}.dh",
        "esn": "cast(null as bigint)",
        "transform_confidence": f"case when size({transforms}) > 0 then 'high' else 'low' end",
    }


def proposal_bodies(sa_payload: str, version: str, v1_skip_doi: bool = False) -> str:
    """Bodies of the proposals of an SA payload.

    ``v1_skip_doi`` jumps the DOI and situation words that real IKEv1 SA bodies start with.
    """
    start = f"case when {version} <> 'IKEv2' then 8 else 0 end" if v1_skip_doi else "0"
    bodies = substructures(sa_payload, start, chained=True)
    return f"filter({bodies}, b -> {size('b')} >= 4)"
