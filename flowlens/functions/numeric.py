"""Rounding with the semantics of correctly rounded decimal output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = "134217729e0"  # 2**27 + 1, splits a double into two 26-bit halves


def round_sql(value: str, digits: int) -> str:
    """Round a double to ``digits`` decimals, ties to even, judged on the exact binary value.

    ``bround`` works on the shortest decimal text of the double and a plain ``rint(x * 10^d)``
    on the rounded product; both mistake values such as 2.675 (stored a little below) for ties.
    The rounding error of the product is recovered with an exact split multiplication and
    decides the apparent ties.
    """
    scale = f"1e{digits}"
    product = f"({value} * {scale})"
    high = f"({value} * {_SPLITTER} - ({value} * {_SPLITTER} - {value}))"
    error = f"(({high} * {scale} - {product}) + ({value} - {high}) * {scale})"
    below = f"cast(floor({product}) as double)"
    return (
        f"(case when {product} - {below} = 5e-1 and {error} <> 0 "
        f"then {below} + case when {error} > 0 then 1e0 else 0e0 end "
        f"else rint({product}) end / {scale})"
    )


def round_half_even(value: str, digits: int) -> Column:
    """``round_sql`` of an expression text; name the operand first when it is costly."""
    return F.expr(round_sql(f"({value})", digits))
