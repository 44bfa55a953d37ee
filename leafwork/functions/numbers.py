"""Rounding of doubles by the value that they hold, and not by the decimal that they print as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

_SPLIT = 134217729.0  # 2 ** 27 + 1, which cuts a double into two halves of 26 bits


def round_even(value: Column, digits: int = 0) -> Column:
    """A double at so many decimals (0 to 6), to nearest; a true tie goes to the even digit.

    2.675 is held as a little less than it says and gives 2.67; 0.125 is a tie and gives 0.12.  The product with twice the
    power of ten is an odd number just where a tie may be, and the exact error of that product, found from halves of the
    factors, tells on which side of the tie the value lies.  Nulls, NaN and infinities stay, and so do values too large to have decimals.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must be from 0 to 6")
    power = float(10**digits)

    def of(x):
        return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52 / (2 * power)), x).otherwise(bound(F.struct(x.alias("x"), (x * (2 * power)).alias("p"), (x * _SPLIT).alias("t")), near))

    def near(s):
        x, p = s["x"], s["p"]
        high = s["t"] - (s["t"] - x)
        error = (high * (2 * power) - p) + (x - high) * (2 * power)
        k = F.rint(p)
        side = (p - k) + error
        even = 2 * F.rint(k / 4)  # of the two neighbours of k / 2, the even one
        tie = F.when(side > 0, (k + 1) / 2).when(side < 0, (k - 1) / 2).otherwise(even)
        return F.when(k % 2 == 0, k / 2).otherwise(tie) / power

    return bound(value.cast("double"), of)
