"""Rounding that is decided on the exact value of a double, as Python's round does it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 2^27 + 1, which splits a double into two halves of 26 bits (Veltkamp).
SPLITTER = 134217729.0
#: From here on x * 10^digits has no fraction that a double can hold.
WHOLE = 2.0**52


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed, and written into the plan, once however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def half_even(x: str | Column, digits: int) -> Column:
    """x (a double) rounded to 0 to 7 digits: the nearest decimal to its exact binary value, and of two equally near ones the even one.

    Spark's own rounding takes the shortest decimal that prints as x, so 0.50015, which lies below its name, becomes 0.5002 there and 0.5001 here. The
    product x * 10^digits is taken with its rounding error (Dekker), which decides where the product alone seems half way. Nulls, NaN,
    infinities and values whose product has no fraction (from 2^52 on) stay; there is no negative zero."""
    if not 0 <= digits <= 7:
        raise ValueError("0 to 7 digits")
    scale = float(10**digits)

    def parts(v: Column) -> Column:
        product, spread = v * scale, v * SPLITTER
        high = spread - (spread - v)
        error = (high * scale - product) + (v - high) * scale
        return F.struct(v.alias("x"), product.alias("product"), F.floor(product).cast("double").alias("below"), error.alias("error"))

    def rounded(p: Column) -> Column:
        beyond = (p["product"] - p["below"]) - 0.5
        up = (beyond > 0) | ((beyond == 0) & ((p["error"] > 0) | ((p["error"] == 0) & (p["below"] % 2 != 0))))
        return F.when(F.abs(p["product"]) < WHOLE, (p["below"] + up.cast("double")) / scale).otherwise(p["x"]) + 0.0

    # x is named before its parts are: they use it a dozen times, and what is rounded inside would be computed as often again
    return let((F.col(x) if isinstance(x, str) else x).cast("double"), lambda v: let(parts(v), rounded))
