from __future__ import annotations

import duckdb
from flowlens.workload import base, security


def _folder(tmp_path) -> str:
    """A small packet log, and the line items and parts of its messages."""
    database = duckdb.connect()
    database.execute("select setseed(0.4)")
    tables = {
        "events": """select i as event_id, timestamp '2024-01-01' + interval (i) second as ts, (i * 7919) % 60 as user_id,
            ['view', 'click', 'signup', 'purchase', 'error'][1 + (i * 31) % 5] as event_type,
            cast(i % 40 as double) as value, '' as props from range(3000) t(i)""",
        "lineitem": """select i as l_orderkey, i % 90 as l_partkey, i % 11 as l_suppkey, cast(1 as int) as l_linenumber,
            cast(i % 50 as double) as l_quantity from range(3000) t(i)""",
        "part": "select i as p_partkey, cast(i % 50 as int) as p_size from range(90) t(i)",
    }
    for name, sql in tables.items():
        database.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    return str(tmp_path)


def test_rule_tables_read_the_log_once(spark, tmp_path, monkeypatch):
    folder, reads = _folder(tmp_path), []
    raw = base.raw_packets
    monkeypatch.setattr(base, "raw_packets", lambda *a, **b: reads.append(a) or raw(*a, **b))
    found = security.QUERIES["L6_anomaly_cap"](spark, folder)
    assert len(reads) == 1
    database = duckdb.connect()
    for name in ("events", "lineitem", "part"):
        database.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    columns = ", ".join(found.columns)
    expected = database.execute(f"select {columns} from ({security.ORACLES['L6_anomaly_cap']})").fetchall()
    assert expected and sorted(map(tuple, found.collect())) == sorted(expected)
    tables = security.tables(spark, folder)
    assert set(tables) == {"analyses", "messages", "proposals", "esp", "ah", "observations"}
    assert all(t.count() for t in tables.values())
