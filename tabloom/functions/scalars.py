"""Scalar expressions whose rounding, division and bounds must be exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields null on a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Bound a value; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def clip_array(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.transform(c, lambda v: clip(v, low, high))


def half_even_long(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def plain_zero(c: Column) -> Column:
    """Drop the sign of zero."""
    return c + F.lit(0.0)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def numeric_cast(c: Column, lenient: bool = False) -> Column:
    return c.try_cast("double") if lenient else c.cast("double")


def argmax_index(c: Column) -> Column:
    """Zero-based position of the first maximum of an array."""
    return F.array_position(c, F.array_max(c)) - 1
