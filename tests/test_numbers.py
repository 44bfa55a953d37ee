"""Rounding against the language's own, which is exact."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafwork.functions.numbers import round_even


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_rounding_of_ties_and_what_only_looks_like_one(spark, digits):
    draw = random.Random(digits)
    scale = 10**digits
    values = [(2 * draw.randrange(-(10**7), 10**7) + 1) / (2 * scale) for _ in range(4000)]  # ties as decimals
    values += [math.nextafter(v, draw.choice([math.inf, -math.inf])) for v in values[:3000]]
    values += [draw.randrange(-(10**6), 10**6) / 2 ** draw.randrange(1, 12) for _ in range(3000)]  # true ties among them
    values += [draw.uniform(-1e3, 1e3) for _ in range(1000)] + [0.0, 2.675, 0.125, 0.05, 0.15, 0.25, 0.35, 1e15 + 0.5, 1e300, 5e-324, 792.05]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", round_even(F.col("v"), digits).alias("r")).collect()
    got = {r["i"]: r["r"] for r in rows}
    wrong = [(v, got[i], round(v, digits)) for i, v in enumerate(values) if got[i] != round(v, digits)]
    assert len(values) > 10_000 and not wrong, wrong[:5]


def test_values_that_stay(spark):
    row = spark.createDataFrame([(None, math.inf, math.nan)], "a double, b double, c double").select(*[round_even(F.col(c), 1).alias(c) for c in "abc"]).first()
    assert row["a"] is None and row["b"] == math.inf and math.isnan(row["c"])
    with pytest.raises(ValueError):
        round_even(F.lit(1.0), 7)
