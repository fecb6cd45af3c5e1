"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """``x`` with a fixed number of decimals, rounded as printf does: to the nearest by its exact binary value, exact halves to even. 0.285 is below the half, so 0.28; 0.125 gives 0.12.

    ``format_string`` rounds the shortest decimal digits half up instead. It stays for what is not a number and from 1e12 on, where the digits asked for are below a double's. Null stays null.
    """
    scale = 10**places
    a = F.abs(x)
    # two parts of few bits, so that their products with the scale are exact
    high = a.cast("float").cast("double")
    low = (a - high) * F.lit(float(scale))
    high = high * F.lit(float(scale))
    n = F.floor(a * F.lit(float(scale)) + 0.5)
    even = n % 2 == 0
    below, above = (high - (n - 0.5)) + low, (high - (n + 0.5)) + low
    n = F.when((below < 0) | ((below == 0) & ~even), n - 1).when((above > 0) | ((above == 0) & ~even), n + 1).otherwise(n)
    # n over the scale has no more decimals than are asked for
    near = F.signum(x) * n / F.lit(float(scale))
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", F.when(a < 1e12, near).otherwise(x)))
