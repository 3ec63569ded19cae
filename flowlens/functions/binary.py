"""Big-endian fields of BINARY values as Spark SQL text (offsets are 0-based).

Decoders are long expressions; as text each column is parsed once instead of being assembled call
by call over the Python gateway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def part(data: str, offset: str | int, length: str | int) -> str:
    """Bytes ``[offset, offset + length)``; short when the data ends earlier."""
    return f"substring({data}, cast({offset} as int) + 1, cast({length} as int))"


def uint(data: str, offset: str | int, width: int) -> str:
    """Unsigned big-endian integer of ``width`` bytes as BIGINT."""
    return f"cast(conv(hex({part(data, offset, width)}), 16, 10) as bigint)"


def hex_text(data: str, offset: str | int, width: int) -> str:
    """Lower-case hex of ``width`` bytes."""
    return f"lower(hex({part(data, offset, width)}))"


def size(data: str) -> str:
    """Byte length."""
    return f"octet_length({data})"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def expand(df: DataFrame, columns: list[str], fields: str, keep: str) -> DataFrame:
    """``columns`` plus the fields of a struct, for rows where ``keep`` holds.

    Written as a generator over a zero- or one-element array: filters on the fields cannot be
    pushed below it, so a costly struct is evaluated once per row instead of once per use.
    """
    rows = f"inline(filter(array({fields}), x -> coalesce({keep}, false)))"
    return df.selectExpr(*columns, rows)


def once(df: DataFrame, columns: list[str], fields: str) -> DataFrame:
    """``columns`` plus the fields of a struct evaluated once per row, for every row."""
    return df.selectExpr(*columns, f"inline(array({fields}))")
