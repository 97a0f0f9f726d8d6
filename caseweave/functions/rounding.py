"""Rounding on the exact binary value with ties to even, as Python's round() does.

F.round works on the shortest decimal text of a double, so 2.675 becomes 2.68 although
the stored value is below the tie. Here the scaled value is kept as an exact sum p + e
(Dekker's product), which decides on which side of the tie the double really lies.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, let

_SPLIT = float(2 ** 27 + 1)


def _product_error(x: Column, p: Column, scale: float) -> Column:
    """x * scale - p without rounding; scale is a power of ten below 2**26."""
    t = x * _SPLIT
    hi = t - (t - x)
    lo = x - hi
    return (hi * scale - p) + lo * scale


def python_round(c: Column | str, digits: int = 0) -> Column:
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    scale = float(10 ** digits)
    x = _col(c).cast("double")

    def decide(s):
        p, e = s["p"], s["e"]
        low = F.floor(p).cast("double")
        side = (p - low - 0.5) + e            # exact near the tie
        odd = F.pmod(low, F.lit(2.0)) == 1.0
        return F.when(side > 0, low + 1).when(side < 0, low).when(odd, low + 1).otherwise(low) / scale

    pair = F.struct((x * scale).alias("p"), _product_error(x, x * scale, scale).alias("e"))
    small = F.abs(x) < 2.0 ** 52 / scale
    return F.when(x.isNull(), F.lit(None).cast("double")).when(small, let(pair, decide)).otherwise(x)
