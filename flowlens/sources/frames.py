"""Frames of pcap and pcapng captures.

A ``Place`` is a byte of a capture with all that the bytes before it decide: byte order, clock, interfaces
and the number of frames so far. ``walk`` cuts frames from a place on, with constant extra memory, so a
capture can be cut from its start or from any record boundary (see ``capture_files``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_by_value

ship_by_value(__name__)

# ---- fixed values: file layouts, sanity limits --------------------------------------------
PCAP_LAYOUTS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6),
    b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9),
    b"\xa1\xb2\x3c\x4d": (">", 1e-9),
}
SECTION_HEADER, INTERFACE, ENHANCED_PACKET = 0x0A0D0D0A, 1, 6
BYTE_ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
OPTION_TIMESTAMP_RESOLUTION = 9
ETHERNET = 1
MAX_FRAME, MAX_BLOCK, MIN_BLOCK = 16_000_000, 64_000_000, 12

_BATCH_FRAMES, _BATCH_BYTES = 20_000, 32 << 20

Frame = tuple[int, float, memoryview, int]


class CaptureError(ValueError):
    """The capture is damaged beyond this point; frames read so far stand."""


class Pieces:
    """Bytes that arrive in pieces; what is read is given up."""

    def __init__(self, pieces: Iterable[bytes | memoryview]) -> None:
        self._pieces, self._held, self._at = iter(pieces), memoryview(b""), 0

    def peek(self, size: int) -> memoryview | None:
        """The next bytes, None where fewer are left."""
        parts, held = [self._held[self._at :]], len(self._held) - self._at
        while held < size:
            piece = next(self._pieces, None)
            if piece is None:
                break
            parts, held = [*parts, piece] if held else [piece], held + len(piece)
        if len(parts) > 1 or held > len(self._held) - self._at:
            self._held, self._at = memoryview(parts[0] if len(parts) == 1 else b"".join(parts)), 0
        return self._held[self._at : self._at + size] if held >= size else None

    def read(self, size: int) -> memoryview | None:
        found = self.peek(size)
        self._at += 0 if found is None else size
        return found


@dataclass
class Place:
    """A record boundary of a capture: ``kind`` is pcap, pcapng, or None where it is neither."""

    kind: str | None
    at: int = 0
    number: int = 0
    order: str = "<"
    unit: float = 1e-6
    interfaces: list[tuple[int, float]] = field(default_factory=list)
    #: nothing can be read after this place
    over: bool = False
    #: a section began since the walk did, so the interfaces are all of its own
    reset: bool = False


def start_of(head: bytes) -> Place:
    """The first record of a capture that begins with these bytes, 24 at least if it has them."""
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        return Place("pcapng", order=BYTE_ORDERS.get(bytes(head[8:12]), "<"))
    layout = PCAP_LAYOUTS.get(bytes(head[:4])) if len(head) >= 24 else None
    return Place(None, over=True) if layout is None else Place("pcap", 24, order=layout[0], unit=layout[1])


def walk(data: Pieces, place: Place, end: float = float("inf")) -> Iterator[Frame]:
    """Frames whose records begin before byte ``end``; ``place`` moves on with them."""
    if place.kind is None:
        return iter(())
    return (_walk_pcap if place.kind == "pcap" else _walk_pcapng)(data, place, end)


def _walk_pcap(data: Pieces, place: Place, end: float) -> Iterator[Frame]:
    """Records of a classic capture: number, stamp, bytes, wire length. A short tail ends it."""
    header = struct.Struct(place.order + "IIII")
    while place.at < end:
        head = data.read(16)
        if head is None:
            break
        seconds, fraction, captured, wire = header.unpack(head)
        if captured > MAX_FRAME:
            place.over = True
            raise CaptureError(f"record {place.number + 1} claims {captured} bytes")
        body = data.read(captured)
        if body is None:
            break
        place.at += 16 + captured
        place.number += 1
        yield place.number, float(seconds) + float(fraction) * place.unit, body, wire
    else:
        return
    place.over = True


def timestamp_resolution(options: memoryview, order: str) -> float:
    """Seconds per tick of a pcapng interface; microseconds unless stated."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        at += 4
        if at + size > len(options):
            break
        if code == OPTION_TIMESTAMP_RESOLUTION and size >= 1:
            exponent = options[at]
            return 2.0 ** -(exponent & 0x7F) if exponent & 0x80 else 10.0**-exponent
        at += size + (-size % 4)
    return 1e-6


def _walk_pcapng(data: Pieces, place: Place, end: float) -> Iterator[Frame]:
    """Enhanced packets of Ethernet interfaces, after the public pcapng block layout.

    Other packets are counted but not returned. Every section carries its own byte order and
    interface list.
    """
    while place.at < end:
        head = data.peek(12)
        if head is None:
            break
        if bytes(head[:4]) == b"\x0a\x0d\x0d\x0a":
            found = BYTE_ORDERS.get(bytes(head[8:]))
            if found is None:
                break
            place.order, place.interfaces, place.reset = found, [], True
        kind, size = struct.unpack_from(place.order + "II", head)
        if not MIN_BLOCK <= size <= MAX_BLOCK:
            place.over = True
            raise CaptureError(f"block at byte {place.at} claims {size} bytes")
        block = data.read(size)
        if block is None:
            break
        body = block[8 : size - 4]
        place.at += size
        if kind == INTERFACE and len(body) >= 8:
            link = struct.unpack_from(place.order + "H", body)[0]
            place.interfaces.append((link, timestamp_resolution(body[8:], place.order)))
        elif kind == ENHANCED_PACKET and len(body) >= 20:
            which, high, low, captured, wire = struct.unpack_from(place.order + "IIIII", body)
            place.number += 1
            known = which < len(place.interfaces)
            link, unit = place.interfaces[which] if known else (ETHERNET, 1e-6)
            if link == ETHERNET:
                stamp = float(((high << 32) | low) * unit)
                yield place.number, stamp, body[20 : 20 + captured], wire
    else:
        return
    place.over = True


def frames_of(pieces: Iterable[bytes | memoryview]) -> Iterator[Frame]:
    data = Pieces(pieces)
    head = data.peek(24) or data.peek(12) or b""
    place = start_of(bytes(head))
    data.read(place.at)
    return walk(data, place)


_SCHEMA = pa.schema(
    [
        ("capture_id", pa.string()),
        ("frame_number", pa.int64()),
        ("ts", pa.float64()),
        ("data", pa.binary()),
        ("orig_length", pa.int64()),
        ("read_error", pa.string()),
    ]
)


class Rows:
    """Frames of captures as record batches of bounded size, under ``key``."""

    def __init__(self, key: str) -> None:
        self.schema = _SCHEMA.set(0, pa.field(key, pa.string()))
        self._rows: list[tuple] = []
        self._held = 0

    def of(self, name: str, found: Iterator[Frame]) -> Iterator[pa.RecordBatch]:
        """Batches that are full; a damaged capture adds a row with its error."""
        try:
            for number, stamp, data, wire in found:
                self._rows.append((name, number, stamp, bytes(data), wire, None))
                self._held += len(data)
                if len(self._rows) >= _BATCH_FRAMES or self._held >= _BATCH_BYTES:
                    yield self.rest()
        except CaptureError as error:
            self._rows.append((name, None, None, None, None, str(error)))

    def rest(self) -> pa.RecordBatch:
        columns = list(zip(*self._rows, strict=True)) or [()] * len(self.schema)
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)]
        self._rows, self._held = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def frame_ddl(key: str = "capture_id") -> str:
    return (
        f"{key} string, frame_number bigint, ts double, data binary, orig_length bigint, "
        "read_error string"
    )


def _split(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    rows = Rows(key)
    for batch in batches:
        for capture, content in zip(batch.column(0), batch.column(1), strict=True):
            yield from rows.of(capture.as_py(), frames_of([memoryview(content.as_buffer())]))
    yield rows.rest()


def scan_frames(captures: DataFrame, key: str = "capture_id") -> DataFrame:
    """Frames of every capture (``key``, content), numbered by position.

    A damaged capture adds one row without a frame that carries ``read_error``.
    """
    return captures.select(key, "content").mapInArrow(partial(_split, key=key), frame_ddl(key))


def readable_frames(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("frame_number").isNotNull()).drop("read_error")


def read_errors(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("read_error").isNotNull()).select("capture_id", "read_error")
