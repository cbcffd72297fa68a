"""Expressions on times and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(gap: Column) -> Column:
    """A day-time interval as whole microseconds, in long arithmetic throughout."""
    gap = gap.cast("interval second")
    second = F.lit(1).cast("interval second")
    seconds = gap.cast("bigint")
    rest = (gap - second * seconds) * 1_000_000
    return seconds * 1_000_000 + rest.cast("bigint")

