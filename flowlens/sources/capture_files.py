"""Capture files of any size, read by byte range.

Files are cut into ranges, and one file's ranges are walked by many tasks. A range does not know where its
first record begins, so:

1. ``survey``: each range looks for the first byte from which a chain of plausible record headers leads on,
   and walks from there to its end: where it leaves the range, how many frames it counted, which sections and
   interfaces it met.
2. ``agree``: per file, one pass over its ranges' few numbers follows the walk from the file's start. Where
   a range began at the place its forerunner left off, both are right; other ranges are surveyed again
   from the right place. What is still open after ``ROUNDS`` rounds is left to one range that goes on to the
   file's end, so the result is always that of reading the file from its start.
3. Frame numbers are prefix sums of the counts. ``read_ranges`` cuts each range's frames from its place.

The agreed ranges are an index of frame offsets that can be stored and read again (see ``packet_source``).
Small files are one range each, packed many to a task, and need no survey. Ranges carry the capture's
id, so frames are never joined or shuffled. Executors open files through Arrow's file systems (local and
shared folders, S3, GCS, HDFS). A file's SHA-256 has no parts; ``identify`` streams each file through one
task with constant memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from flowlens.session import ship_by_value, store
from flowlens.sources.frames import (
    BYTE_ORDERS,
    MAX_BLOCK,
    MAX_FRAME,
    MIN_BLOCK,
    CaptureError,
    Pieces,
    Place,
    Rows,
    frame_ddl,
    start_of,
    walk,
)

ship_by_value(__name__)

#: bytes of a range; bytes read at once
RANGE, CHUNK = 64 << 20, 4 << 20
#: tasks for each core that small ranges are packed into, where their bytes do not ask for more
TASKS_A_CORE = 4
#: headers in a row that make a place a record boundary
CHAIN = 8
#: surveys of ranges that began at a wrong place
ROUNDS = 3
#: bytes searched together for a boundary
WINDOW = 1 << 20

_MET = pa.list_(pa.struct([("link", pa.int32()), ("unit", pa.float64())]))
_RANGE = [
    ("key", pa.string()), ("uri", pa.string()), ("length", pa.int64()), ("part", pa.int32()),
    ("first", pa.int64()), ("last", pa.int64()), ("at", pa.int64()),
]
_STATE = [("order", pa.string()), ("interfaces", _MET)]
#: columns of an index
INDEX = pa.schema([*_RANGE, ("number", pa.int64()), *_STATE])
_AGREED = pa.schema([*INDEX, ("entry_order", pa.string()), ("again", pa.bool_())])
_SURVEYED = pa.schema(
    [*_RANGE, ("entry_order", pa.string()), ("leaves", pa.int64()), ("over", pa.bool_())]
    + [("frames", pa.int64()), ("reset", pa.bool_()), *_STATE]
)


def open_file(uri: str) -> pa.NativeFile:
    """A file that Spark names by ``uri``, for reads at any byte."""
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def pieces(file: pa.NativeFile, at: int) -> Iterator[bytes]:
    """The file's bytes from ``at`` on, a chunk at a time."""
    while chunk := file.read_at(CHUNK, at):
        yield chunk
        at += len(chunk)


def _limit(total: int, count: int, range_bytes: int, least: int) -> int:
    return max(1, min(count, max(least, -(-total // range_bytes))))


def _dealt(rows: DataFrame, size: str, range_bytes: int) -> DataFrame:
    """Rows in as many partitions as their bytes ask for; a task takes many small ranges one after another."""
    total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    least = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(_limit(int(total), count, max(range_bytes, RANGE), least))


def identify(files: DataFrame, max_bytes: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``uri``, ``magic`` and ``sha256`` of every file that is neither empty nor above ``max_bytes``."""
    wanted = files.where("length > 0" if max_bytes is None else f"length > 0 and length <= {max_bytes}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                with open_file(uri) as file:
                    magic, hashed = file.read_at(4, 0), hashlib.sha256()
                    for piece in pieces(file, 0):
                        hashed.update(piece)
                columns = [[uri], [magic.hex().upper()], [hashed.hexdigest()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uri", "magic", "sha256"])

    dealt = _dealt(wanted.select("uri", "length"), "length", range_bytes)
    return dealt.mapInArrow(task, "uri string, magic string, sha256 string")


# ---- places ------------------------------------------------------------------------------------
def _numbers(data: bytes, order: str, at: int) -> np.ndarray:
    """The 32-bit number ``at`` bytes after every byte of ``data``."""
    count = max(0, len(data) - at - 3)
    return np.ndarray((count,), dtype=order + "u4", buffer=data, offset=at if count else 0, strides=(1,))


def _plausible_pcap(data: bytes, start: Place) -> np.ndarray:
    count = max(0, len(data) - 15)
    fraction, captured, wire = (_numbers(data, start.order, k)[:count] for k in (4, 8, 12))
    # empty frames are left out, for zeros would lead on through any padding
    return (fraction < round(1 / start.unit)) & (captured > 0) & (captured <= wire) & (wire <= MAX_FRAME)


def _plausible_pcapng(data: bytes, start: Place, first: int) -> np.ndarray:
    size = _numbers(data, start.order, 4)
    good = (size >= MIN_BLOCK) & (size <= MAX_BLOCK) & (size % 4 == 0)
    at = np.arange(len(good))
    good &= (at + first) % 4 == 0
    # a block ends with its size again
    close = np.flatnonzero(good & (at + size <= len(data)))
    every = _numbers(data, start.order, 0)
    good[close] &= every[close + size[close].astype(np.int64) - 4] == size[close]
    return good


def _leads_on(file: pa.NativeFile, at: int, length: int, start: Place) -> bool:
    """Whether a chain of headers goes on from here, or to the end of the file."""
    for _ in range(CHAIN):
        if at == length:
            return True
        head = file.read_at(16, at)
        if start.kind == "pcap":
            if len(head) < 16 or not _plausible_pcap(head, start)[0]:
                return False
            at += 16 + int(_numbers(head, start.order, 8)[0])
        else:
            order = BYTE_ORDERS.get(head[8:12], start.order) if head[:4] == b"\x0a\x0d\x0d\x0a" else start.order
            if len(head) < 12:
                return False
            size = int(_numbers(head, order, 4)[0])
            if not MIN_BLOCK <= size <= MAX_BLOCK or size % 4 or file.read_at(4, at + size - 4) != head[4:8]:
                return False
            at += size
        if at > length:
            return False
    return True


def boundary(file: pa.NativeFile, first: int, last: int, length: int, start: Place) -> int | None:
    """The first byte of a range that looks like a record's; a guess that ``agree`` checks."""
    for low in range(first, last, WINDOW):
        data = file.read_at(min(WINDOW, last - low) + 15, low)
        good = _plausible_pcap(data, start) if start.kind == "pcap" else _plausible_pcapng(data, start, low)
        for at in np.flatnonzero(good).tolist():
            if low + at < last and _leads_on(file, low + at, length, start):
                return low + at
    return None


def _surveyed(row: dict) -> tuple:
    """Where a walk from the row's place, or from a guess, leaves the range, and what it met."""
    with open_file(row["uri"]) as file:
        place = start_of(file.read_at(24, 0))
        if row["at"] is not None:
            place.at, place.order = row["at"], row["entry_order"] or place.order
        elif row["part"]:
            place.at = boundary(file, row["first"], row["last"], row["length"], place) if place.kind else None
        known = (*[row[c] for c in ("key", "uri", "length", "part", "first", "last")], place.at, place.order)
        if place.at is None:
            return (*known, None, False, 0, False, place.order, [])
        try:
            for _ in walk(Pieces(pieces(file, place.at)), place, row["last"]):
                pass
        except CaptureError:
            pass
    met = [{"link": link, "unit": unit} for link, unit in place.interfaces]
    return (*known, place.at, place.over, place.number, place.reset, place.order, met)


def _survey_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [dict(zip(_SURVEYED.names, _surveyed(row), strict=True)) for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(found, schema=_SURVEYED)


def survey(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """``ranges`` walked from ``at``, or from a guessed place where that is null."""
    wanted = ranges.select(*[n for n, _ in _RANGE], "entry_order", (F.col("last") - F.col("first")).alias("size"))
    return _dealt(wanted, "size", range_bytes).drop("size").mapInArrow(_survey_task, from_arrow_schema(_SURVEYED))


def follow(rows: list[dict], to_the_end: bool) -> list[dict]:
    """The ranges of one file, in order, with the places that a walk from its start enters them at.

    ``again`` marks ranges surveyed from another place; until they are surveyed anew the walk is taken to
    leave them where it seemed to. With ``to_the_end`` the first such range takes in all that follow.
    """
    out: list[dict] = []
    at, number, order, interfaces, over = rows[0]["at"], 0, rows[0]["entry_order"], [], False
    for row in rows:
        base = {c: row[c] for c in ("key", "uri", "length", "part", "first", "last")}
        if over or at is None or at >= row["last"]:
            continue
        entered = {**base, "at": at, "number": number, "order": order, "entry_order": order, "interfaces": interfaces}
        right = row["at"] == at and row["entry_order"] == order
        if not right and to_the_end:
            return [*out, {**entered, "last": row["length"], "again": False}]
        out.append({**entered, "again": not right})
        if not right and row["leaves"] is None:
            # where the walk leaves this range is not known yet
            return out
        at, over, number = row["leaves"], row["over"], number + row["frames"]
        order = row["order"]
        interfaces = row["interfaces"] if row["reset"] else [*interfaces, *row["interfaces"]]
    return out


def agree(surveyed: DataFrame, to_the_end: bool) -> DataFrame:
    """``follow`` for every file; a file's ranges are a few numbers each."""

    def task(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist(follow(rows, to_the_end), schema=_AGREED)

    return surveyed.groupBy("uri").applyInArrow(task, from_arrow_schema(_AGREED))


def frame_index(files: DataFrame, key: str = "capture_id", range_bytes: int = RANGE) -> DataFrame:
    """Ranges of every file (``key``, ``uri``, ``length``) with the place where their frames begin.

    Columns of ``INDEX``: a row for each range that a record begins in; ``at`` is that record's byte and
    ``number`` the frames before it. Whole small files have no ``at``, and begin at their start.
    """
    size = F.lit(range_bytes).cast("long")
    parts = F.expr(f"sequence(0L, (greatest(length, 1L) - 1) div {range_bytes}L)")
    ranges = files.select(F.col(key).cast("string").alias("key"), "uri", "length", F.explode(parts).alias("part"))
    ranges = ranges.select(
        "key", "uri", "length", F.col("part").cast("int"), (F.col("part") * size).alias("first"),
        F.least((F.col("part") + 1) * size, "length").alias("last"),
        F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("entry_order"),
    )
    ranges = store(ranges, "capture-ranges")
    small = ranges.where(F.col("length") <= size).selectExpr(
        "key", "uri", "length", "part", "first", "last", "at", "0L as number", "cast(null as string) as order",
        "cast(null as array<struct<link:int,unit:double>>) as interfaces",
    )
    large = ranges.where(F.col("length") > size)
    if not large.take(1):
        return small
    surveyed = store(survey(large, range_bytes), "capture-survey")
    for turn in range(ROUNDS + 1):
        found = store(agree(surveyed, turn == ROUNDS), "capture-index")
        wrong = found.where("again")
        if not wrong.take(1):
            break
        rest = surveyed.join(wrong.select("uri", "part"), ["uri", "part"], "left_anti").select(surveyed.columns)
        surveyed = store(rest.unionByName(survey(wrong, range_bytes)), "capture-survey")
    return small.unionByName(found.select(*INDEX.names))


def place_of(row: dict, file: pa.NativeFile) -> Place:
    """The place where a range's frames begin."""
    place = start_of(file.read_at(24, 0))
    if row["at"] is not None:
        place.at, place.number, place.order = row["at"], row["number"], row["order"]
        place.interfaces = [(x["link"], x["unit"]) for x in row["interfaces"]]
    return place


def range_frames(row: dict) -> Iterator[tuple]:
    """Frames of one row of an index."""
    with open_file(row["uri"]) as file:
        place = place_of(row, file)
        yield from walk(Pieces(pieces(file, place.at)), place, row["last"])


def read_ranges(index: DataFrame, key: str = "capture_id", range_bytes: int = RANGE) -> DataFrame:
    """Frames of the ranges of an index; a damaged capture adds a row that carries ``read_error``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(key)
        for batch in batches:
            for row in batch.to_pylist():
                yield from rows.of(row["key"], range_frames(row))
        yield rows.rest()

    dealt = _dealt(index.withColumn("size", F.col("last") - F.col("first")), "size", range_bytes)
    return dealt.drop("size").mapInArrow(task, frame_ddl(key))


def scan_captures(files: DataFrame, key: str = "capture_id", range_bytes: int = RANGE) -> DataFrame:
    """Frames of whole captures (``key``, ``uri``, ``length``), each file spread over tasks."""
    return read_ranges(frame_index(files, key, range_bytes), key, range_bytes)


def write_index(files: DataFrame, target: str, key: str = "capture_id", range_bytes: int = RANGE) -> None:
    """Store the index of ``files`` as Parquet, in order of capture, for ``packet_source``."""
    index = frame_index(files, key, range_bytes)
    index.repartitionByRange("key", "part").sortWithinPartitions("key", "part").write.parquet(target)


def write_captures(records: DataFrame, target: str, suffix: str) -> None:
    """Files under the folder ``target``, named by capture: its ``header``, then ``record`` by ``frame_number``.

    A capture's bytes have one order, so one task streams them; it writes aside and then moves the file into
    place, so a task that runs again leaves a whole file.
    """
    system, folder = pyarrow.fs.FileSystem.from_uri(target)
    system.create_dir(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pyarrow.fs.FileSystem.from_uri(target)
        name, out, aside, written = None, None, "", 0

        def close() -> pa.RecordBatch:
            out.close()
            system.move(aside, f"{folder}/{name}{suffix}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], ["capture_id", "length"])

        for batch in batches:
            for capture, header, record in zip(*[batch[c] for c in ("capture_id", "header", "record")], strict=True):
                if capture.as_py() != name:
                    if out is not None:
                        yield close()
                    name, written = capture.as_py(), 0
                    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(aside)
                    written += out.write(header.as_buffer())
                written += out.write(record.as_buffer())
        if out is not None:
            yield close()

    rows = records.select("capture_id", "frame_number", "header", "record")
    sorted_ = rows.repartition("capture_id").sortWithinPartitions("capture_id", "frame_number")
    sorted_.mapInArrow(task, "capture_id string, length long").write.format("noop").mode("overwrite").save()
