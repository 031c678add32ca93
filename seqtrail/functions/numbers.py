"""Small numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(dividend: Column, divisor: int | Column) -> Column:
    """Exact integer division of non-negative longs."""
    divisor = divisor if isinstance(divisor, Column) else F.lit(divisor)
    return F.call_function("div", dividend, divisor).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null instead of failing on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


#: Depths at which the series below 2 and the continued fraction from 2 on are exact to 1e-13.
SERIES, FRACTION = 40, 60


def erfc(x: Column) -> Column:
    """Complementary error function of a value of at least 0, as plain arithmetic."""
    t = 2.0 * x * x
    series = F.lit(1.0)
    for k in range(SERIES, 0, -1):
        series = 1.0 + t / (2.0 * k + 1.0) * series
    fraction = x
    for k in range(FRACTION, 0, -1):
        fraction = x + (k / 2.0) / fraction
    tail = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2.0, 1.0 - tail * 2.0 * x * series).otherwise(tail / fraction)


def erfc_sql(x: str) -> str:
    """The same arithmetic as SQL over a column name."""
    t = f"(2e0 * {x} * {x})"
    series = "1e0"
    for k in range(SERIES, 0, -1):
        series = f"(1e0 + {t} / {2 * k + 1}e0 * {series})"
    fraction = x
    for k in range(FRACTION, 0, -1):
        fraction = f"({x} + {k / 2.0!r} / {fraction})"
    tail = f"(exp(-{x} * {x}) / cast('{math.sqrt(math.pi)!r}' as double))"
    return f"(case when {x} < 2 then 1e0 - {tail} * 2e0 * {x} * {series} else {tail} / {fraction} end)"
