from __future__ import annotations

import struct

import capture_bytes as cb
import pytest
from flowlens.operators import decode


def rows_of(spark, frames):
    table = spark.createDataFrame(
        [("c", i + 1, 1.0 + i, bytearray(f)) for i, f in enumerate(frames)],
        "capture_id string, frame_number long, ts double, data binary",
    )
    return decode.decode_packets(table)


A6, B6 = bytes.fromhex("fd00" + "00" * 13 + "01"), bytes.fromhex("fd00" + "00" * 13 + "02")


def extension(following: int, length: int = 0) -> bytes:
    return bytes([following, length]) + bytes(6 + 8 * length)


CASES = {
    "tcp": (cb.ether(cb.ip4(cb.tcp(80, 81), "1.2.3.4", "5.6.7.8", 6)), ("tcp", 80, False)),
    "short tcp": (cb.ether(cb.ip4(b"abc", "1.2.3.4", "5.6.7.8", 6)), ("tcp", None, False)),
    "no udp bytes": (cb.ether(cb.ip4(b"", "1.2.3.4", "5.6.7.8", 17)), ("unknown", None, False)),
    "icmp": (cb.ether(cb.ip4(b"x" * 8, "1.2.3.4", "5.6.7.8", 1)), ("icmp", None, False)),
    "vlan": (cb.ether(cb.ip4(cb.tcp(80, 81), "1.2.3.4", "5.6.7.8", 6), tag=0x8100), ("tcp", 80, False)),
    "raw ip": (cb.ip4(cb.tcp(80, 81), "1.2.3.4", "5.6.7.8", 6), ("tcp", 80, False)),
    "arp": (cb.ether(b"\x00" * 30, 0x0806), None),
    "garbage": (b"\xff" * 60, None),
    "short header": (cb.ether(b"\x45" + b"\x00" * 10), None),
    "udp fragment": (cb.ether(cb.ip4(cb.udp(b"", 1, 2), "1.2.3.4", "5.6.7.8", 17, 0x2000)), ("udp", None, True)),
    "esp fragment": (cb.ether(cb.ip4(cb.esp(1, 1), "1.2.3.4", "5.6.7.8", 50, 5)), ("unknown", None, True)),
    "padding": (cb.ether(cb.ip4(cb.esp(1, 1)[:4], "1.2.3.4", "5.6.7.8", 50) + b"\x00" * 40), ("unknown", None, False)),
    "no length": (cb.ether(cb.ip4(cb.esp(1, 1), "1.2.3.4", "5.6.7.8", 50, total=0)), ("esp", None, False)),
    "short ah": (cb.ether(cb.ip4(b"\x04" * 11, "1.2.3.4", "5.6.7.8", 51)), ("unknown", None, False)),
    "ipv6": (cb.ether(cb.ip6(cb.udp(b"", 7, 9), A6, B6, 17), 0x86DD), ("udp", 7, False)),
    "ipv6 chain": (
        cb.ether(cb.ip6(extension(60) + extension(17, 1) + cb.udp(b"", 7, 9), A6, B6, 0), 0x86DD),
        ("udp", 7, False),
    ),
    "ipv6 fragment": (
        cb.ether(cb.ip6(extension(17) + cb.udp(b"", 7, 9), A6, B6, 44), 0x86DD),
        ("udp", None, True),
    ),
    "ipv6 cut chain": (cb.ether(cb.ip6(bytes([17, 9]) + bytes(6), A6, B6, 60), 0x86DD), None),
    "natt esp": (cb.ether(cb.ip4(cb.udp(cb.esp(9, 3), 4500, 4500), "1.2.3.4", "5.6.7.8", 17)), ("esp", 4500, False)),
    "natt short": (cb.ether(cb.ip4(cb.udp(b"\xff" * 5, 4500, 1), "1.2.3.4", "5.6.7.8", 17)), ("udp", 4500, False)),
    "natt ike": (
        cb.ether(cb.ip4(cb.udp(bytes(4) + cb.sa_init(), 4500, 4500), "1.2.3.4", "5.6.7.8", 17)),
        ("udp", 4500, False),
    ),
    "short ike": (cb.ether(cb.ip4(cb.udp(bytes(27), 500, 500), "1.2.3.4", "5.6.7.8", 17)), ("udp", 500, False)),
}


def test_frames_one_by_one(spark):
    names = list(CASES)
    found = {names[r["packet_id"] - 1]: r for r in rows_of(spark, [CASES[n][0] for n in names]).collect()}
    for name, (frame, expected) in CASES.items():
        if expected is None:
            assert name not in found, name
            continue
        row = found[name]
        assert (row["protocol"], row["source_port"], row["fragmented"]) == expected, name
        assert row["length"] == len(frame)
    assert found["ipv6"]["source"] == "fd00:" + "0000:" * 6 + "0001"
    assert found["tcp"]["source"] == "1.2.3.4"
    assert found["natt esp"]["esp"]["nat_t"] and found["natt esp"]["esp"]["sequence_number"] == 3
    assert found["natt ike"]["ike"]["exchange_name"] == "IKE_SA_INIT"
    assert found["natt ike"]["evidence"] == [decode.TEXT_NATT_IKE]
    assert found["short ike"]["ike"] is None


def message(spark, body: bytes, first: int = 33, version: int = 0x20, flags: int = 1):
    frame = cb.ether(cb.ip4(cb.udp(cb.ike(first, version, 34, flags, body), 500, 500), "1.2.3.4", "5.6.7.8", 17))
    return decode.ike_messages(rows_of(spark, [frame]))


@pytest.mark.parametrize(
    ("body", "first", "names"),
    [
        (cb.payload(34, b"") + cb.payload(40, b"x") + cb.payload(0, b"y"), 33, ["SA", "KE", "NONCE"]),
        (cb.payload(46, b"") + cb.payload(35, b"z"), 33, ["SA", "SK"]),
        (b"\x00\x00", 33, []),
        (cb.payload(99, b"") + struct.pack(">BBH", 34, 0, 2), 33, ["SA", "PAYLOAD_99"]),
        (b"".join(cb.payload(41, b"") for _ in range(40)), 41, ["NOTIFY"] * 40),
    ],
)
def test_payload_chain(spark, body, first, names):
    assert message(spark, body, first).first()["payload_types"] == names


def test_overrunning_payload_hides_the_sa(spark):
    body = struct.pack(">BBH", 33, 0, 400) + cb.payload(0, b"abcd")
    assert message(spark, body, 34).first()["sa_payload"] is None


def test_proposals(spark):
    lifetimes = struct.pack(">HHI", 14 << 8, 4, 192)  # long-form key length
    first = cb.proposal(1, 1, [cb.transform(1, 12, lifetimes), cb.transform(1, 20), cb.transform(5, 1)], 2, b"SPI8")
    second = cb.proposal(2, 3, [cb.transform(1, 99), cb.transform(3, 77), cb.transform(2, 66)], 2)
    third = cb.proposal(3, 7, [], 0)
    rows = decode.ike_proposals(message(spark, cb.payload(0, first + second + third), flags=0)).collect()
    assert [r["proposal_number"] for r in rows] == [1, 2, 3]
    assert (rows[0]["encryption"], rows[0]["key_length"], rows[0]["esn"]) == ("AES_GCM_8", None, 1)
    assert (rows[1]["encryption"], rows[1]["integrity"], rows[1]["prf"]) == ("ENCR_99", "INTEG_77", "PRF_66")
    assert (rows[2]["protocol_name"], rows[2]["transform_confidence"]) == ("UNKNOWN", "low")
    assert {r["status"] for r in rows} == {"SELECTED"}


def test_bare_transform_ends_the_walk(spark):
    bare = struct.pack(">BBH", 0, 0, 4)
    offer = cb.proposal(1, 3, [cb.transform(1, 12), bare])
    row = decode.ike_proposals(message(spark, cb.payload(0, offer))).first()
    assert (row["encryption"], row["transform_confidence"]) == ("AES_CBC", "high")


def test_initiator_bit_is_a_parameter(spark):
    table = rows_of(spark, [cb.ether(cb.ip4(cb.udp(cb.ike(46, 0x20, 35, 0x08, b""), 500, 500), "1.1.1.1", "2.2.2.2", 17))])
    assert decode.ike_messages(table).first()["direction"] == "responder"
    assert decode.ike_messages(table, initiator_mask=0x08).first()["direction"] == "initiator"


def test_phase1_cipher_and_doi(spark):
    attributes = struct.pack(">HH", 0x8001, 7) + struct.pack(">HH", 0x8004, 128)
    body = struct.pack(">BBHBBH", 0, 0, 8 + len(attributes), 1, 1, 0) + attributes
    offer = struct.pack(">BBH", 0, 0, 8 + len(body)) + bytes([1, 1, 0, 1]) + body
    plain = message(spark, cb.payload(0, offer), 1, 0x10)
    row = decode.ike_proposals(plain).first()
    assert (row["encryption"], row["key_length"]) == ("AES_CBC", 128)
    real = message(spark, cb.payload(0, struct.pack(">II", 1, 1) + offer), 1, 0x10)
    assert decode.ike_proposals(real, v1_skip_doi=True).first()["encryption"] == "AES_CBC"
