"""Packet sources by name: ``spark.read.format("capture_frames")``.

The format reads captures through a stored index of frame offsets (``capture_files.write_index``), a partition
for every range of bytes of about ``rangeBytes``. With ``option("pushFilters", "true")``, filters on
``capture_id`` (equality, ``in``) and on ``frame_number`` (comparisons) are pushed into the scan: they choose the
ranges that are opened, and what is read stops at the last frame wanted. Spark keeps one planned scan for a
loaded frame, so two uses of it with different filters would read each other's ranges; load a frame for each
use with that option. Without it every use reads all ranges and Spark filters the rows. A source of another
kind registers a class of its own under its name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from flowlens.session import ship_by_value
from flowlens.sources.capture_files import RANGE, range_frames
from flowlens.sources.frames import Rows, frame_ddl

ship_by_value(__name__)

FORMAT = "capture_frames"
_UNBOUNDED = 2**63 - 1


class Ranges(InputPartition):
    """Rows of an index that one task reads."""

    def __init__(self, rows: list[dict]) -> None:
        super().__init__(rows)


class CaptureReader(DataSourceReader):
    """Frames of the captures of an index."""

    def __init__(self, options: dict) -> None:
        self.index = options["index"]
        self.range_bytes = int(options.get("rangeBytes", RANGE))
        self.pushes = options.get("pushFilters", "false").lower() == "true"
        self.captures: set[str] | None = None
        self.low, self.high = 1, _UNBOUNDED

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take the filters that ranges can answer; the others are left to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None) if self.pushes else None
            if name == ("capture_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.captures = wanted if self.captures is None else self.captures & wanted
            elif name == ("frame_number",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif name == ("frame_number",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("frame_number",) and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def bounded(self) -> bool:
        """Whether frame numbers are asked for, which a damaged capture's error row does not have."""
        return (self.low, self.high) != (1, _UNBOUNDED)

    def partitions(self) -> list[Ranges]:
        system, path = pyarrow.fs.FileSystem.from_uri(self.index)
        wanted = None if self.captures is None else pc.field("key").isin(sorted(self.captures))
        rows = pa.dataset.dataset(path, filesystem=system, format="parquet").to_table(filter=wanted).to_pylist()
        rows.sort(key=lambda r: (r["uri"], r["part"]))
        kept = []
        for row, after in zip(rows, [*rows[1:], None], strict=True):
            last = after["number"] if after is not None and after["uri"] == row["uri"] else _UNBOUNDED
            # its frames are those after ``number`` up to the next range's
            if row["number"] < self.high and last >= self.low:
                kept.append(row)
        return [Ranges(part) for part in packed(kept, self.range_bytes)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows = Rows("capture_id")
        for row in partition.value:
            yield from rows.of(row["key"], self._frames(row))
        batch = rows.rest()
        yield batch.filter(pc.is_valid(batch["frame_number"])) if self.bounded() else batch

    def _frames(self, row: dict) -> Iterator[tuple]:
        for frame in range_frames(row):
            if frame[0] > self.high:
                return
            if frame[0] >= self.low:
                yield frame


def packed(rows: list[dict], size: int) -> list[list[dict]]:
    """Rows together that have at most ``size`` bytes, or one that has more."""
    out: list[list[dict]] = []
    held = size + 1
    for row in rows:
        own = row["last"] - row["first"]
        if held + own > size:
            out.append([])
            held = 0
        out[-1].append(row)
        held += own
    return out


class CaptureFrames(DataSource):
    """``option("index", folder)`` names the stored index of frame offsets."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return frame_ddl()

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureFrames)
