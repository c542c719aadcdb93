"""Rounding as Python does it: the exact binary value counts, and half goes to the even digit.

F.round rounds half up and F.bround half to even, both on the shortest decimal text of a double: 2.675 is 2.67499999...
and must give 2.67. Here x * 2 * 10**n is held exactly as the sum of two doubles (x is split into halves of 26 bits, by
Veltkamp's method, so that both products are exact) and compared with the odd number between two results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = float(2**27 + 1)


def python_round(x: Column, digits: int = 0) -> Column:
    """x to 0 to 7 decimal places; null, NaN and infinite values stay, a small negative number gives -0.0."""
    if not 0 <= digits <= 7:
        raise ValueError("0 to 7 digits")
    x = x.cast("double")
    size, scale = F.abs(x), float(10**digits)
    c = size * SPLIT
    high = c - (c - size)
    low = size - high
    twice_high, twice_low = high * (2 * scale), low * (2 * scale)  # exact, and so is their sum as a pair
    below = F.floor(size * scale).cast("double")
    # its sign is exact; beyond 2**53 the odd number has no double, but the distance from the even one then has few bits
    beyond = F.when(below < float(2**52), (twice_high - (below * 2 + 1)) + twice_low).otherwise((twice_high - below * 2) + twice_low - 1)
    even = below % 2 == 0
    whole = F.when((beyond > 0) | ((beyond == 0) & ~even), below + 1).otherwise(below)
    rounded = whole / scale
    fits = (size * scale < float(2**53)) & ~F.isnan(x)
    return F.when(~fits | x.isNull() | (size == 0), x).when(x < 0, -rounded).otherwise(rounded)


def mean4(total: Column, n: Column) -> Column:
    """The mean of `n` whole ten-millionths that sum to `total` (decimals without places), to four decimals, half away from zero; null of none."""
    twice = 2000 * F.nullif(n, F.lit(0)).cast("decimal(12,0)")
    up = (2 * F.abs(total) + twice / 2).cast("decimal(38,0)")
    return F.signum(total) * F.call_function("div", up, twice) / 10000.0
