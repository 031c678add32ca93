"""Time arithmetic on epoch microseconds, and time-delta categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Labels of the time-delta categories and their upper bounds in seconds.
FIRST_ROW = "<FIRST_ROW>"
DELTA_LABELS = ["[TD_0]", "[TD_10]", "[TD_60]", "[TD_>60]"]
DELTA_BOUNDS = [2, 10, 60]


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, read in the session zone."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(text: Column, fmt: str | None = None) -> Column:
    """Whole epoch seconds of a timestamp given as text."""
    parsed = F.to_timestamp(text, fmt) if fmt else F.to_timestamp(text)
    return F.unix_seconds(parsed)


def delta_seconds(us: Column, previous_us: Column) -> Column:
    """Seconds since the previous row, null on the first one."""
    return (us - previous_us) / F.lit(float(SECOND))


def delta_category(seconds: Column) -> Column:
    """category token of a time delta."""
    category = F.lit(DELTA_LABELS[-1])
    for label, bound in reversed(list(zip(DELTA_LABELS, DELTA_BOUNDS))):
        category = F.when(seconds <= bound, F.lit(label)).otherwise(category)
    return F.when(seconds.isNull(), F.lit(FIRST_ROW)).otherwise(category)


def delta_bucket(seconds: Column, threshold: int = 60) -> Column:
    """whole seconds up to the threshold, then logarithmic steps."""
    coarse = F.log1p(seconds).cast("int") + threshold
    return F.when(seconds <= threshold, seconds.cast("int")).otherwise(coarse)


def is_first_or_slow(delta: Column, cutoff: float | None) -> Column:
    """Keep the first row of a sequence and rows at least ``cutoff`` seconds apart."""
    if cutoff is None:
        return F.lit(True)
    return delta.isNull() | (delta >= cutoff)
