"""Flow keys, endpoint rendering and the row chunks used to split hot groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows of one group that one task sees at once in order-dependent operators.
CHUNK_ROWS = 65536
# Ids per stored evidence chunk.
EVIDENCE_CHUNK = 10000


def endpoint_sql(ip: str, port: str) -> str:
    """``ip:port`` as SQL text; ``x`` marks a missing port, port 0 stays distinct from it."""
    return f"concat({ip}, ':', coalesce(cast({port} as string), 'x'))"


def flow_key_sql(prefix: str = "") -> str:
    """Directed key ``src:sport-proto/ipver->dst:dport`` over packet columns, as SQL text."""
    source = endpoint_sql(f"{prefix}source", f"{prefix}source_port")
    target = endpoint_sql(f"{prefix}destination", f"{prefix}destination_port")
    return f"concat({source}, '-', {prefix}protocol, '/', {prefix}ip_version, '->', {target})"


def flow_pair_sql() -> str:
    """Undirected key: both directions of a conversation give the same text."""
    a = endpoint_sql("source", "source_port")
    b = endpoint_sql("destination", "destination_port")
    return f"concat_ws('|', protocol, ip_version, least({a}, {b}), greatest({a}, {b}))"


def chunk_of(packet_id: Column, rows: int = CHUNK_ROWS) -> Column:
    """Position range of a packet inside its capture; at most ``rows`` packets share a chunk."""
    return F.expr("0") if rows <= 0 else F.floor(packet_id / F.lit(rows)).cast("bigint")
