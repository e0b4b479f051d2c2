"""Exact decimal arithmetic: results keep every digit or raise. Quotients and rescaled values hold 28 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest scale.
MAX_SCALE = 18


def _checked_scale(scale: int) -> int:
    if not 0 <= scale <= MAX_SCALE:
        raise ValueError(f"a scale is 0 to {MAX_SCALE}")
    return scale


def _exact(c: Column, scale: int, what: str) -> Column:
    """c at a scale; an error where digits would be lost."""
    kept = c.cast(f"decimal(28,{scale})")  # wider, and a comparison would round
    return F.when(c.isNull(), F.lit(None)).when(kept == c, kept).otherwise(F.raise_error(F.lit(f"decimal {what} would lose precision")))


def plus(a: Column, b: Column) -> Column:
    return a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column, scale_a: int, scale_b: int) -> Column:
    """The scales add up."""
    return (a * b).cast(f"decimal(38,{_checked_scale(scale_a + scale_b)})")


def divide_exact(a: Column, b: Column, scale: int) -> Column:
    """A quotient with so many digits behind the point; an error if it has more, or for a divisor of 0."""
    q = F.try_divide(a.cast("decimal(28,6)"), b).cast(f"decimal(28,{_checked_scale(scale)})")
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.raise_error(F.lit("cannot divide by zero"))).when(q * b == a, q).otherwise(F.raise_error(F.lit("decimal division would lose precision")))


def rescale_exact(c: Column, scale: int) -> Column:
    return _exact(c, _checked_scale(scale), "rescale")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, whatever the scales."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
