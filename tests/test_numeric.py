from __future__ import annotations

import random

from flowlens.functions.numeric import round_half_even
from pyspark.sql import functions as F


def test_rounding_equals_correctly_rounded_decimal(spark):
    rng = random.Random(7)
    values = [k / n for n in (8, 40, 200, 400, 1000) for k in range(0, 3000, 7)]
    values += [2.675, 1.005, 8.345, 0.285, 1.115, 0.0, 1e9 + 0.125]
    values += [rng.uniform(0, 10 ** rng.randint(0, 9)) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[round_half_even("v", d).alias(f"r{d}") for d in (2, 4, 6)]
    )
    for row in rows.collect():
        for digits in (2, 4, 6):
            assert row[f"r{digits}"] == round(row["v"], digits), (row["v"], digits)
