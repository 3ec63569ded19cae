"""Hand-made frames and capture files for the tests."""

from __future__ import annotations

import struct


def ether(body: bytes, kind: int = 0x0800, tag: int | None = None) -> bytes:
    head = bytes.fromhex("00112233445566778899aabb")
    if tag is not None:
        head += struct.pack(">HH", tag, 5)
    return head + struct.pack(">H", kind) + body


def ip4(body: bytes, src: str, dst: str, proto: int, frag: int = 0, total: int | None = None) -> bytes:
    def packed(text: str) -> bytes:
        return bytes(int(x) for x in text.split("."))

    size = 20 + len(body) if total is None else total
    head = struct.pack(">BBHHHBBH", 0x45, 0, size, 0, frag, 64, proto, 0)
    return head + packed(src) + packed(dst) + body


def ip6(body: bytes, src: bytes, dst: bytes, following: int) -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(body), following, 64) + src + dst + body


def udp(body: bytes, sport: int, dport: int) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def tcp(sport: int, dport: int) -> bytes:
    return struct.pack(">HH", sport, dport) + bytes(16)


def esp(spi: int, seq: int, body: bytes = b"") -> bytes:
    return struct.pack(">II", spi, seq) + body


def ah(spi: int, seq: int, body: bytes = bytes(24)) -> bytes:
    return struct.pack(">BBHII", 4, 0, 0, spi, seq) + body


def ike(first: int, version: int, exchange: int, flags: int, body: bytes, spi: bytes = b"\x11") -> bytes:
    return (
        spi * 8
        + bytes(8)
        + bytes([first, version, exchange, flags])
        + struct.pack(">II", 0, 28 + len(body))
        + body
    )


def payload(following: int, body: bytes) -> bytes:
    return struct.pack(">BBH", following, 0, 4 + len(body)) + body


def transform(kind: int, code: int, attributes: bytes = b"") -> bytes:
    return struct.pack(">BBHBBH", 0, 0, 8 + len(attributes), kind, 0, code) + attributes


def proposal(number: int, protocol: int, transforms: list[bytes], more: int = 0, spi: bytes = b"") -> bytes:
    body = bytes([number, protocol, len(spi), len(transforms)]) + spi + b"".join(transforms)
    return struct.pack(">BBH", more, 0, 4 + len(body)) + body


AES256 = struct.pack(">HH", 0x8000 | (14 << 8), 256)


def sa_init() -> bytes:
    offer = proposal(
        1, 3, [transform(1, 18, AES256), transform(3, 5), transform(2, 5), transform(4, 19)]
    )
    return ike(33, 0x20, 34, 1, payload(0, offer))


def v1_aggressive() -> bytes:
    attributes = b"".join(struct.pack(">HHI", k, 4, v) for k, v in ((5, 3), (6, 2), (3, 2)))
    body = struct.pack(">BBHBBH", 2, 0, 8 + len(attributes), 1, 5, 0) + attributes
    offer = struct.pack(">BBH", 1, 0, 8 + len(body)) + bytes([1, 1, 0, 1]) + body
    return ike(1, 0x10, 4, 0, payload(0, offer), b"\x22")


def demo_frames() -> list[tuple[float, bytes]]:
    frames, ts = [], 1_000_000.0
    a, b = "10.0.0.1", "10.0.0.2"

    def add(frame: bytes, gap: float) -> None:
        nonlocal ts
        frames.append((ts, ether(frame)))
        ts += gap

    for _ in range(4):
        add(ip4(udp(sa_init(), 500, 500), a, b, 17), 0.05)
    for n in range(3):
        add(ip4(ah(0x10101010, n + 1), a, b, 51), 0.02)
    for n in range(12):
        add(ip4(esp(0xDEADBEEF, n + 1, bytes(128)), a, b, 50), 0.01)
    for _ in range(3):
        add(ip4(udp(b"hello", 53, 53), a, "8.8.8.8", 17), 0.1)
    return frames


def ikev1_frames() -> list[tuple[float, bytes]]:
    frame = ether(ip4(udp(v1_aggressive(), 500, 500), "10.0.0.3", "10.0.0.4", 17))
    return [(2_000_000.0 + 0.1 * i, frame) for i in range(2)]


def plain_frames() -> list[tuple[float, bytes]]:
    frames = []
    for i in range(6):
        frames.append((3e6 + 0.2 * i, ether(ip4(udp(b"hello", 53, 53), "10.0.0.1", "8.8.8.8", 17))))
        frames.append(
            (3e6 + 0.2 * i + 0.1, ether(ip4(udp(b"hello", 12345, 8080), "10.0.0.1", "10.0.0.2", 17)))
        )
    return frames


def pcap(frames: list[tuple[float, bytes]], order: str = "<", nano: bool = False) -> bytes:
    magic, unit = (0xA1B23C4D, 1e9) if nano else (0xA1B2C3D4, 1e6)
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for ts, data in frames:
        whole = int(ts)
        out += struct.pack(order + "IIII", whole, round((ts - whole) * unit), len(data), len(data)) + data
    return out


def pcapng(frames: list[tuple[float, bytes]], order: str = "<", resolution: int | None = None) -> bytes:
    def block(kind: int, body: bytes) -> bytes:
        body += bytes(-len(body) % 4)
        size = struct.pack(order + "I", 12 + len(body))
        return struct.pack(order + "I", kind) + size + body + size

    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    options = b""
    unit = 1e6
    if resolution is not None:
        options = struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0)
        unit = 10.0**resolution
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535) + options)
    for ts, data in frames:
        stamp = round(ts * unit)
        head = struct.pack(order + "IIIII", 0, stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data))
        out += block(6, head + data)
    return out
