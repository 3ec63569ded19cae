from __future__ import annotations

import capture_bytes as cb
import shipping
from flowlens.operators import replay
from flowlens.sources import frames


def test_task_functions_need_no_install(spark, monkeypatch, tmp_path):
    functions = shipping.record(monkeypatch)
    content = spark.createDataFrame([("c", bytearray(cb.pcap(cb.plain_frames())))], "capture_id string, content binary")
    assert frames.scan_frames(content).count()
    ddl = "capture_id string, source_table string, spi string, direction string, packet_id long, sequence_number long"
    packets = spark.createDataFrame([("c", "ah_packets", "s", "upstream", 1, 5)], ddl)
    assert replay.replay_anomalies(packets).count() == 0
    assert len(functions) >= 3
    shipping.load_elsewhere(functions, tmp_path)
