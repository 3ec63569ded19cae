from __future__ import annotations

import hashlib
import random
import struct

import capture_bytes as cb
import pytest
from flowlens.session import store
from flowlens.sources import capture_files, catalogue, frames, packet_source


def scan(spark, content: bytes):
    table = spark.createDataFrame([("c", bytearray(content))], "capture_id string, content binary")
    return frames.scan_frames(table)


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True), (">", True)])
def test_pcap_layouts_and_cut_tail(spark, order, nano):
    content = cb.pcap(cb.plain_frames(), order, nano)
    rows = frames.readable_frames(scan(spark, content[:-3])).orderBy("frame_number").collect()
    assert [r["frame_number"] for r in rows] == list(range(1, 12))
    for row, (ts, data) in zip(rows, cb.plain_frames(), strict=False):
        assert abs(row["ts"] - ts) < 1e-6 and bytes(row["data"]) == data
        assert row["orig_length"] == len(data)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("resolution", [None, 6, 9])
def test_pcapng(spark, order, resolution):
    content = cb.pcapng(cb.demo_frames(), order, resolution)
    rows = frames.readable_frames(scan(spark, content)).orderBy("frame_number").collect()
    assert len(rows) == 22
    for row, (ts, data) in zip(rows, cb.demo_frames(), strict=True):
        assert abs(row["ts"] - ts) < 1e-6 and bytes(row["data"]) == data


def test_damaged_capture_keeps_its_frames(spark):
    content = cb.pcap(cb.plain_frames()[:2]) + b"\x00" * 8 + b"\xff\xff\xff\x7f" + b"\x00" * 40
    scanned = scan(spark, content)
    assert frames.readable_frames(scanned).count() == 2
    assert "claims" in frames.read_errors(scanned).first()["read_error"]


def test_catalogue_checks_in_order(spark):
    good = cb.pcap(cb.plain_frames())
    files = [
        ("a.pcap", good, None, "pcap"),
        ("b.PCAPNG", cb.pcapng(cb.plain_frames()), None, "pcapng"),
        ("", good, "no_file_selected", None),
        ("..", good, "no_file_selected", None),
        ("x/y.pcap", good, "path_separator_in_name", None),
        ("x\\y.pcap", good, "path_separator_in_name", None),
        ("notes.txt", b"", "unsupported_extension", None),
        (".pcap", good, "unsupported_extension", None),
        ("c.cap", b"", "empty_file", None),
        ("big.cap", good * 30, "file_too_large", None),
        ("d.cap", b"PK\x03\x04", "unrecognised_content", None),
    ]
    table = spark.createDataFrame(
        [(n, len(c), bytearray(c)) for n, c, _, _ in files], "filename string, length long, content binary"
    )
    rows = {r["filename"]: r for r in catalogue.catalogue(table, max_bytes=20_000).collect()}
    for name, content, reason, kind in files:
        assert rows[name]["reject_reason"] == reason, name
        assert rows[name]["capture_format"] == kind
    assert len(rows["a.pcap"]["sha256"]) == 64


def test_no_size_is_refused_without_a_limit(spark):
    row = ("a.pcap", 3 << 30, bytearray(cb.pcap(cb.plain_frames())))
    table = spark.createDataFrame([row], "filename string, length long, content binary")
    assert catalogue.catalogue(table).first()["reject_reason"] is None


def _awkward_captures() -> dict[str, bytes]:
    """Captures whose bytes look like records where none begins, are damaged, or change their layout."""
    r = random.Random(4)
    lines = [(float(i), b"\n" * (i % 4) + bytes([i]) * 40 + b"\n" * (i % 3)) for i in range(40)]
    nested = cb.pcap([(float(i), bytes([i]) * 60) for i in range(1, 60)])
    frames_ = [(float(i), bytes(r.randrange(256) for _ in range(r.randrange(1, 300)))) for i in range(150)]
    inside = [(5.0, nested * 3), *frames_, (6.0, bytes(9000)), *frames_[:9], (7.0, b"")]
    sections = b"".join(cb.pcapng(part, order, unit) for part, order, unit in
                        ((frames_[:50], "<", None), (frames_[50:90], ">", 9), (frames_[90:], "<", 6)))
    return {
        "a b.pcap": cb.pcap(lines),
        "cut.pcap": cb.pcap(lines) + b"\n\n",
        "c.pcapng": cb.pcapng(lines),
        "damaged.pcap": cb.pcap(lines[:2]) + b"\x00" * 8 + b"\xff\xff\xff\x7f" + b"\n" * 4000,
        "inside.pcap": cb.pcap(inside, ">"),
        "nanos.pcap": cb.pcap(frames_, "<", True),
        "sections.pcapng": sections,
        "broken.pcapng": sections[:9000] + bytes(8) + sections[9000:],
        "zeros.pcap": cb.pcap([(1.0, bytes(20_000)), (2.0, b"x" * 10)] * 3),
        "mark.pcap": b"\xef\xbb\xbf" + cb.pcap(lines),
        "short.pcap": cb.pcap([])[:20],
        "empty.pcap": b"",
        "nested.pcapng": cb.pcapng([(1.0, cb.pcapng(frames_[:20]) * 4), *frames_[:30]]),
    }


@pytest.mark.parametrize("range_bytes", [700, 4096, 1 << 26])
def test_ranges_give_the_frames_of_a_walk_from_the_start(spark, tmp_path, range_bytes):
    contents = _awkward_captures()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = catalogue.list_files(spark, str(tmp_path)).withColumnRenamed("filename", "capture_id")
    got: dict[str, list] = {n: [] for n in contents}
    for r in capture_files.scan_captures(files, range_bytes=range_bytes).collect():
        got[r["capture_id"]].append((r["frame_number"], r["ts"], r["data"] and bytes(r["data"]), r["orig_length"], r["read_error"]))
    for name, content in contents.items():
        expected = []
        try:
            for number, ts, data, wire in frames.frames_of([content]):
                expected.append((number, ts, bytes(data), wire, None))
        except frames.CaptureError as error:
            expected.append((None, None, None, None, str(error)))
        assert sorted(got[name], key=repr) == sorted(expected, key=repr), name
    if range_bytes < 1 << 20:
        large = capture_files.frame_index(files, range_bytes=range_bytes).where("part > 0")
        assert large.count() > 20


def test_identity_of_files(spark, tmp_path):
    contents = _awkward_captures()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = catalogue.list_files(spark, str(tmp_path))
    seen = capture_files.identify(files, max_bytes=60_000)
    rows = {r["filename"]: r for r in catalogue.catalogue(files.join(seen, "uri", "left"), 60_000).collect()}
    assert set(rows) == set(contents) - {"empty.pcap"}  # Spark's listing leaves empty files out
    for name, content in contents.items():
        if name in rows and rows[name]["reject_reason"] is None:
            assert rows[name]["sha256"] == hashlib.sha256(content).hexdigest()
    reasons = {n: r["reject_reason"] for n, r in rows.items() if r["reject_reason"]}
    assert reasons == {"mark.pcap": "unrecognised_content", "zeros.pcap": "file_too_large"}


def test_boundary_guess_is_mostly_right(spark, tmp_path):
    r = random.Random(1)
    path = tmp_path / "x.pcap"
    rows = [(float(i), bytes(r.randrange(256) for _ in range(r.randrange(1, 200)))) for i in range(400)]
    path.write_bytes(cb.pcap(rows))
    starts, at = set(), 24
    for _, data in rows:
        starts.add(at)
        at += 16 + len(data)
    with capture_files.open_file(str(path)) as file:
        place = frames.start_of(file.read_at(24, 0))
        found = [capture_files.boundary(file, k, k + 2000, at, place) for k in range(1000, at - 2000, 1500)]
    assert len(found) > 15 and set(found) <= starts


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("captures")
    for name, content in _awkward_captures().items():
        (tmp_path / name).write_bytes(content)
    files = catalogue.list_files(spark, str(tmp_path)).withColumnRenamed("filename", "capture_id")
    capture_files.write_index(files, f"{tmp_path}/index", range_bytes=2048)
    packet_source.register(spark)

    def load(push: bool = False):
        options = {"index": f"{tmp_path}/index", "rangeBytes": 2048, "pushFilters": push}
        return spark.read.format(packet_source.FORMAT).options(**options).load()

    return load, store(capture_files.scan_captures(files), "frames")


def test_format_equals_the_scan(indexed):
    source, scanned = indexed[0](), indexed[1]
    assert source.schema == scanned.schema
    assert sorted(source.collect(), key=repr) == sorted(scanned.collect(), key=repr)


@pytest.mark.parametrize(
    "condition",
    [
        "capture_id = 'nanos.pcap'", "capture_id in ('inside.pcap', 'damaged.pcap', 'none')",
        "capture_id = 'nanos.pcap' and frame_number = 77", "frame_number > 140", "frame_number <= 3",
        "capture_id = 'sections.pcapng' and frame_number >= 60 and frame_number < 95", "frame_number = 0",
        "capture_id = 'a b.pcap' and capture_id = 'cut.pcap'", "read_error is not null", "orig_length > 250",
    ],
)
def test_filters_reach_the_format(indexed, condition):
    load, scanned = indexed
    expected = sorted(scanned.where(condition).collect(), key=repr)
    for push in (True, False):
        assert sorted(load(push).where(condition).collect(), key=repr) == expected


def test_filters_choose_ranges(indexed, capsys):
    load, _ = indexed
    some = load(True).where("capture_id = 'nanos.pcap' and frame_number between 70 and 75")
    assert some.rdd.getNumPartitions() <= 3 < 20 < load(True).rdd.getNumPartitions()
    capsys.readouterr()
    some.explain("formatted")
    assert "EqualTo(capture_id,nanos.pcap), GreaterThanOrEqual(frame_number,70)" in capsys.readouterr().out
    source = load()  # used twice, which pushed filters would not stand
    one, two = source.where("capture_id = 'a b.pcap'"), source.where("capture_id = 'nanos.pcap' and frame_number <= 3")
    assert one.union(two).count() == 43
    assert packet_source.packed([{"first": 0, "last": n} for n in (3, 4, 9, 1)], 8) == [
        [{"first": 0, "last": 3}, {"first": 0, "last": 4}], [{"first": 0, "last": 9}], [{"first": 0, "last": 1}],
    ]


def test_files_written_from_records(spark, tmp_path):
    rows = [(c, n, b"HEAD", struct.pack(">I", n)) for c in ("x", "y") for n in (3, 1, 2)]
    table = spark.createDataFrame(rows, "capture_id string, frame_number long, header binary, record binary")
    capture_files.write_captures(table, f"{tmp_path}/out", ".pcap")
    expected = b"HEAD" + b"".join(struct.pack(">I", n) for n in (1, 2, 3))
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert found == {"x.pcap": expected, "y.pcap": expected}


def test_small_ranges_are_packed_into_tasks(spark):
    ranges = spark.range(2000).selectExpr("id", "1000L as size")
    dealt = capture_files._dealt(ranges, "size", 1000)
    assert dealt.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert dealt.count() == 2000
