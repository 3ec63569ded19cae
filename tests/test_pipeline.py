from __future__ import annotations

import capture_bytes as cb
import pytest
from flowlens.operators import findings, rules, sinks
from flowlens.plans import analysis, assessment


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    source, target = tmp_path_factory.mktemp("captures"), tmp_path_factory.mktemp("tables")
    (source / "demo.pcap").write_bytes(cb.pcap(cb.demo_frames()))
    (source / "v1.pcapng").write_bytes(cb.pcapng(cb.ikev1_frames()))
    (source / "plain.cap").write_bytes(cb.pcap(cb.plain_frames(), ">"))
    (source / "arp.pcap").write_bytes(cb.pcap([(1.0, cb.ether(b"\x00" * 30, 0x0806))]))
    (source / "notes.txt").write_bytes(b"hello")
    analysis.run_analysis(spark, str(source), str(target))
    captures = spark.read.parquet(f"{target}/captures").collect()
    return str(target), {r["filename"]: r for r in captures}


def rows(spark, folder, table, capture):
    return spark.read.parquet(f"{folder}/{table}").where(f"capture_id = '{capture}'").collect()


def test_captures(spark, analysed):
    folder, captures = analysed
    assert {n: r["status"] for n, r in captures.items()} == {
        "demo.pcap": "completed",
        "v1.pcapng": "completed",
        "plain.cap": "completed",
        "arp.pcap": "failed",
    }
    assert captures["demo.pcap"]["packet_count"] == 22
    rejected = spark.read.parquet(f"{folder}/rejected_files").collect()
    assert [(r["filename"], r["reject_reason"]) for r in rejected] == [("notes.txt", "unsupported_extension")]


def test_demo_tables(spark, analysed):
    folder, captures = analysed
    demo = captures["demo.pcap"]["capture_id"]
    counts = {t: len(rows(spark, folder, t, demo)) for t in ("messages", "esp", "ah", "flows", "features")}
    assert counts == {"messages": 4, "esp": 12, "ah": 3, "flows": 4, "features": 4}
    summary = rows(spark, folder, "analyses", demo)[0]
    assert (summary["ipsec"], summary["confidence"], summary["flow_count"]) == ("yes", "high", 4)
    assert summary["ike_detected"] and summary["esp_detected"] and not summary["ipv6_detected"]
    proposal = rows(spark, folder, "proposals", demo)[0]
    assert (proposal["encryption"], proposal["key_length"], proposal["dh_group"]) == ("AES_GCM_16", 256, 19)
    plain = captures["plain.cap"]["capture_id"]
    assert rows(spark, folder, "analyses", plain)[0]["ipsec"] == "no"


def test_assessment_is_idempotent(spark, analysed):
    folder, captures = analysed
    first = {r["rule_id"]: r["created"] for r in assessment.run_assessment(spark, folder).collect()}
    assert len(first) == 10
    found = spark.read.parquet(f"{folder}/findings").collect()
    by_capture = {n: {f["rule_id"] for f in found if f["capture_id"] == r["capture_id"]} for n, r in captures.items()}
    assert by_capture["demo.pcap"] == {"IPSEC-CRYPTO-001", "IPSEC-IKE-001", "IPSEC-META-001"}
    # the corrected attribute offset also shows the weak group of the IKEv1 capture
    assert by_capture["v1.pcapng"] == {"IPSEC-CRYPTO-002", "IPSEC-DH-001", "IPSEC-META-001"}
    assert by_capture["plain.cap"] == set()
    assert sorted(f["finding_id"] for f in found) == [f"SEC-{i:06d}" for i in range(1, len(found) + 1)]
    cited = spark.read.parquet(f"{folder}/finding_evidence").where("rule_id = 'IPSEC-CRYPTO-001'").collect()
    assert [len(c["packet_ids"]) for c in cited] == [12]

    second = assessment.run_assessment(spark, folder).collect()
    assert sum(r["created"] for r in second) == 0
    assert {r["rule_id"]: r["skipped"] for r in second} == first
    assert spark.read.parquet(f"{folder}/findings").count() == len(found)


def test_runs_into_one_target_keep_each_other(spark, tmp_path):
    folders = {n: tmp_path / n for n in ("a", "b", "tables")}
    for folder in folders.values():
        folder.mkdir()
    (folders["a"] / "a.pcap").write_bytes(cb.pcap(cb.demo_frames()))
    (folders["b"] / "b.pcap").write_bytes(cb.pcap(cb.plain_frames()))
    (folders["b"] / "b.txt").write_bytes(b"no")
    target = str(folders["tables"])

    def state():
        found = {}
        for table in ("captures", "packets", "esp", "proposals", "flows"):
            counted = spark.read.schema("capture_id string").parquet(f"{target}/{table}")
            counted = counted.groupBy("capture_id").count().collect()
            found[table] = {r["capture_id"]: r["count"] for r in counted}
        return found

    analysis.run_analysis(spark, str(folders["a"]), target)
    first = state()
    assert first["packets"] == {"CAP-000001": 22} and first["esp"] == {"CAP-000001": 12}
    analysis.run_analysis(spark, str(folders["b"]), target)
    both = state()
    assert both["packets"] == {"CAP-000001": 22, "CAP-000002": 12}
    assert both["esp"] == first["esp"] and both["proposals"] == first["proposals"]
    analysis.run_analysis(spark, str(folders["a"]), target)
    analysis.run_analysis(spark, str(folders["b"]), target)
    assert state() == both
    assert spark.read.parquet(f"{target}/rejected_files").count() == 1
    # fewer frames leave nothing of the fuller run behind
    analysis.run_analysis(spark, str(folders["a"]), target, max_packets=4)
    assert state()["packets"] == {"CAP-000001": 4, "CAP-000002": 12}
    assert state()["esp"] == {}
    cut = {r["capture_id"]: r["truncated"] for r in spark.read.parquet(f"{target}/captures").collect()}
    assert cut == {"CAP-000001": True, "CAP-000002": False}
    gone = spark.createDataFrame([("CAP-000001",)], "capture_id string")
    sinks.delete_captures(spark, target, ["captures", "packets", "flows", "esp"], gone)
    assert state()["packets"] == {"CAP-000002": 12} and set(state()["captures"]) == {"CAP-000002"}


def test_digest_ignores_row_order(spark):
    ddl = "capture_id string, rule_id string, group_key string, kind string, packet_id long"
    refs = [("c", "r", "g", "packet", i) for i in (5, 12_000, 3, 5)]
    chunks = findings.evidence_chunks(spark.createDataFrame(refs, ddl))
    again = findings.evidence_chunks(spark.createDataFrame(refs[::-1], ddl).repartition(3))
    a, b = (findings.evidence_digests(c).first() for c in (chunks, again))
    assert a == b and a["packet_refs"] == 3
    assert {tuple(r["packet_ids"]) for r in chunks.collect()} == {(3, 5), (12_000,)}


def test_carrier_can_be_excluded(spark):
    tables = {
        "analyses": spark.createDataFrame([("a", "yes"), ("b", "yes")], "capture_id string, ipsec string"),
        "observations": spark.createDataFrame(
            [("a", "udp", 4), ("a", "ike", 4), ("b", "udp", 5), ("b", "ike", 4)],
            "capture_id string, protocol string, packet_count long",
        ),
        "messages": spark.createDataFrame([], "capture_id string, packet_id long"),
    }
    assert rules.plaintext_beside_ipsec(tables)[0].count() == 2
    rest = rules.plaintext_beside_ipsec(tables, exclude_carrier=True)[0].collect()
    assert [(r["capture_id"], r["note"]) for r in rest] == [
        ("b", "Plaintext protocols with packet counts: udp=1")
    ]


def test_registry_is_checked():
    with pytest.raises(ValueError, match="duplicate"):
        rules.check_registry((rules.RULES[0], rules.RULES[0]))
