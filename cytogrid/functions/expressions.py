"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """NaN becomes NULL, so that averages and counts skip it."""
    return F.when(~F.isnan(value), value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def fixed(value: Column, digits: int) -> Column:
    """Number as text, rounding the exact binary value half to even.

    ``format_string`` rounds half up on the decimal form instead, which turns
    0.25 into 0.3.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def draw_order(seed: int, *keys: Column) -> Column:
    """Sort key that shuffles rows reproducibly, whatever their partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw_uniform(seed: int, *keys: Column) -> Column:
    """Uniform number in (0, 1), a function of the seed and the row's keys."""
    word = F.conv(F.substring(draw_order(seed, *keys), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / F.lit(4294967296.0)


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for a, b in zip(left, right):
        total = total + (a - b) * (a - b)
    return total
