"""Packet, message and proposal tables derived from the supplied tables.

No packet table is supplied, so ``events`` is read as a packet log. The same definition exists
twice, as Spark SQL and as DuckDB SQL, from one template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.dims import ENCRYPTION, INTEGRITY, PRF

_RAW = """
  select event_id, user_id, value, {micros} as us,
    case when user_id % 25 = 24 then 12 when user_id % 25 = 23 then 13 else user_id % 12 end as cap,
    event_id % 3 = 0 as flip,
    case when user_id % 25 = 24 then 'view'
      when user_id % 25 = 23 then case when event_type = 'view' then 'view' else 'signup' end
      when event_id % 97 = 0 then 'noise' else event_type end as kind
  from events"""

_SIDES = """
  select *, case when cap in (10, 11) and kind = 'click' then user_id % 12 else user_id end as an,
    case when cap in (10, 11) and kind = 'click' then 0 else user_id % 7 end as bn,
    case when user_id % 10 = 9 then 6 else 4 end as ipv,
    case kind when 'view' then 'tcp' when 'error' then 'esp' when 'purchase' then 'ah'
      when 'noise' then 'unknown' else 'udp' end as proto,
    cast(case kind when 'view' then 1024 + user_id % 60000 when 'click' then 500
      when 'signup' then 4500 end as int) as ap,
    cast(case kind when 'view' then 443 when 'click' then 500
      when 'signup' then 1024 + user_id % 60000 end as int) as bp
  from raw"""

_ADDRESS4 = (
    "concat('{net}.', cast({div65536} % 256 as {S}), '.', cast({div256} % 256 as {S}), '.', "
    "cast({n} % 256 as {S}))"
)


def _address(n: str, net4: str, net6: str, text: str) -> str:
    def div(by: int) -> str:
        return f"cast(floor({n} / {by}.0e0) as bigint)"

    four = _ADDRESS4.format(net=net4, n=n, div65536=div(65536), div256=div(256), S=text)
    six = (
        f"concat('{net6}:0000:0000:0000:0000:', "
        f"lpad(lower(hex({div(65536)})), 4, '0'), ':', lpad(lower(hex({n} % 65536)), 4, '0'))"
    )
    return f"case when ipv = 6 then {six} else {four} end"


_ROWS = """
  select event_id, user_id, cap, flip, kind, an, bn, us,
    concat('CAP-', lpad(cast(cap + 1 as {S}), 6, '0')) as capture_id,
    event_id + 1 as packet_id,
    us / 1e6 as ts,
    cast(60 + floor(value * 3) as int) as length,
    case when flip then b else a end as source,
    case when flip then a else b end as destination,
    cast(ipv as int) as ip_version,
    proto as protocol,
    case when proto in ('tcp', 'udp') then proto end as transport,
    case when flip then bp else ap end as source_port,
    case when flip then ap else bp end as destination_port,
    case when proto in ('esp', 'ah') then lower(lpad(hex(user_id % 50), 8, '0')) end as spi,
    case when proto in ('esp', 'ah') then greatest((event_id * 900000) % 4294967296
      - case when event_id % 11 = 0 then 3000000000 else 0 end, 0) end as sequence_number,
    case when kind = 'click' then case when cap in (10, 11) then 'IKE_SA_INIT'
      else case event_id % 4 when 0 then 'IKE_SA_INIT' when 1 then 'IKE_AUTH'
        when 2 then 'CREATE_CHILD_SA' else 'INFORMATIONAL' end end end as exchange_name,
    cast(event_id % 2 as int) as flags,
    lpad(lower(hex(user_id * 7919 + 1)), 16, '0') as initiator_spi,
    lpad(lower(hex(user_id % 5)), 16, '0') as responder_spi
  from addressed"""

_TEXTS = {
    "click": "IKE header parsed (IKEv2)",
    "error": "ESP header parsed (protocol 50)",
    "purchase": "AH header parsed (protocol 51)",
}


def _template(text: str, micros: str) -> str:
    addresses = (
        f"select *, {_address('an', '10', 'fd00:0001', text)} as a, "
        f"{_address('bn', '172', 'fd00:0002', text)} as b from sides"
    )
    return (
        f"raw as ({_RAW.format(micros=micros)}),\nsides as ({_SIDES}),\n"
        f"addressed as ({addresses}),\npkt as ({_ROWS.format(S=text)})"
    )


def micros_sql(column: str) -> str:
    """Microseconds since 1970 of a zone-less stamp, whatever the session's time zone."""
    since = f"({column} - timestamp_ntz'1970-01-01 00:00:00')"
    whole = (
        f"extract(day from {since}) * 86400 + extract(hour from {since}) * 3600 "
        f"+ extract(minute from {since}) * 60"
    )
    fraction = f"cast(extract(second from {since}) * 1000000 as bigint)"
    return f"(cast({whole} as bigint) * 1000000 + {fraction})"


_SPARK = _template("string", micros_sql("ts"))
# ---- DuckDB: "with recursive" so that oracles may add recursive parts ----------------------
PACKETS_SQL = "with recursive " + _template("varchar", "epoch_us(ts)")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_packets(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """Flat packet rows, with the helper columns the frame builder needs, dealt to ``tasks`` tasks."""
    dealt = f"select /*+ repartition({tasks}) */ * from" if tasks else "select * from"
    log = f"({dealt} parquet.`{folder}/events.parquet`)"
    body = _SPARK.replace("from events", f"from {log}")
    rows = spark.sql(f"with {body} select * from pkt")
    # evaluated once per row; otherwise the optimiser repeats the address texts in every use
    return rows.selectExpr("inline(array(struct(*)))")


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """The packet table: nested IKE, ESP and AH layers and evidence texts."""
    texts = " ".join(f"when '{kind}' then '{text}'" for kind, text in _TEXTS.items())
    return raw_packets(spark, folder).selectExpr(
        "capture_id",
        "packet_id",
        "ts",
        "length",
        "source",
        "destination",
        "ip_version",
        "protocol",
        "transport",
        "source_port",
        "destination_port",
        "false as fragmented",
        """case when exchange_name is not null then named_struct('version', 'IKEv2',
            'initiator_spi', initiator_spi, 'responder_spi', responder_spi,
            'exchange_name', exchange_name, 'flags', flags,
            'payload_types', case when exchange_name = 'IKE_SA_INIT' then array('SA', 'KE', 'NONCE')
              when exchange_name = 'CREATE_CHILD_SA' and cap < 6 then array('SA', 'KE')
              when exchange_name = 'CREATE_CHILD_SA' then array('SA') else array('SK') end) end
            as ike""",
        """case when protocol = 'esp' then named_struct('spi', spi, 'sequence_number',
            sequence_number, 'encryption_algorithm', 'UNKNOWN', 'nat_t', false) end as esp""",
        """case when protocol = 'ah' then named_struct('spi', spi, 'sequence_number',
            sequence_number, 'next_header', 4) end as ah""",
        f"array_compact(array(case kind {texts} end)) as evidence",
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """IKE messages of the packet table."""
    return messages_of(packets(spark, folder))


def messages_of(rows: DataFrame) -> DataFrame:
    """IKE messages of some packets."""
    return rows.where("ike is not null").selectExpr(
        "capture_id",
        "concat(capture_id, ':', packet_id) as ike_message_id",
        "packet_id",
        "ts",
        "source as source_ip",
        "destination as destination_ip",
        "ike.exchange_name",
        "ike.payload_types",
        "ike.initiator_spi",
        "ike.responder_spi",
        "if((ike.flags & 1) <> 0, 'initiator', 'responder') as direction",
    )


MESSAGES_SQL = PACKETS_SQL + """,
msg as (
  select capture_id, concat(capture_id, ':', cast(packet_id as varchar)) as ike_message_id,
    packet_id, event_id, ts, source as source_ip, destination as destination_ip, exchange_name,
    exchange_name = 'IKE_SA_INIT' or (exchange_name = 'CREATE_CHILD_SA' and cap < 6) as has_ke,
    initiator_spi, responder_spi,
    case when flags = 1 then 'initiator' else 'responder' end as direction
  from pkt where exchange_name is not null)"""


def _named(table: dict, key: str, prefix: str, text: str) -> str:
    arms = " ".join(f"when {code} then '{name}'" for code, name in table.items())
    return f"case {key} {arms} else concat('{prefix}', cast({key} as {text})) end"


def _proposal_columns(text: str) -> str:
    cipher = _named(ENCRYPTION, "p_partkey % 27", "ENCR_", text)
    mac = _named(INTEGRITY, "p_partkey % 15", "INTEG_", text)
    prf = _named(PRF, "p_partkey % 10", "PRF_", text)
    return f"""
    l_linenumber as proposal_number,
    case l_suppkey % 3 when 0 then 'IKE' when 1 then 'AH' else 'ESP' end as protocol_name,
    {cipher} as encryption,
    case when p_size % 7 = 0 then null else 64 * (p_size % 5) end as key_length,
    {mac} as integrity, {prf} as prf,
    cast(case when p_partkey % 5 = 0 then null
      when exchange_name = 'CREATE_CHILD_SA' and capture_id > 'CAP-000008' then null
      else p_partkey % 32 end as int) as dh_group,
    case when direction = 'initiator' then 'OFFERED' else 'SELECTED' end as status,
    case when l_quantity > 25 then 'high' else 'low' end as transform_confidence"""


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Crypto proposals: line items of the order whose key is the message's event."""
    return proposals_of(spark, folder, messages(spark, folder))


def proposals_of(spark: SparkSession, folder: str, sent: DataFrame) -> DataFrame:
    """Crypto proposals of some messages."""
    offered = sent.selectExpr(
        "capture_id",
        "ike_message_id",
        "packet_id",
        "exchange_name",
        "direction",
        "packet_id - 1 as l_orderkey",
    )
    lines = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    parts = read(spark, folder, "part").selectExpr("p_partkey", "p_size", "p_partkey as l_partkey")
    joined = lines.join(offered, "l_orderkey").join(parts, "l_partkey")
    return joined.selectExpr(
        "capture_id",
        "ike_message_id",
        "packet_id",
        *[c.strip() for c in _split(_proposal_columns("string"))],
    )


def _split(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    depth, start, out = 0, 0, []
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


PROPOSALS_SQL = MESSAGES_SQL + f""",
prop as (
  select m.capture_id, m.ike_message_id, m.packet_id, m.initiator_spi, m.responder_spi,
    m.exchange_name, {_proposal_columns("varchar")}
  from lineitem l join msg m on l.l_orderkey = m.event_id join part p on p.p_partkey = l.l_partkey)"""
