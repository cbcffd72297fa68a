"""Position of a value among sorted constants, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Above this many constants nested conditions outgrow one compiled method; a binary
# search over an array constant is used instead.
MAX_CONDITIONS = 64


def search_sorted(value: Column, points: list, right: bool = False) -> Column:
    """How many ``points`` lie below ``value`` (``right``: below or equal).

    ``points`` are sorted constants, plain or as columns. NULL stays NULL.
    """
    if len(points) <= MAX_CONDITIONS:
        found = _halve(value, points, 0, len(points), right)
    else:
        found = _search(value, points, right)
    return F.when(value.isNotNull(), found)


def _above(value: Column, point: Column, right: bool) -> Column:
    return (value >= point) if right else (value > point)


def _halve(value: Column, points: list, low: int, high: int, right: bool) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(_above(value, F.lit(points[middle]), right),
                  _halve(value, points, middle + 1, high, right)) \
        .otherwise(_halve(value, points, low, middle, right))


def _search(value: Column, points: list, right: bool) -> Column:
    """Jumps of falling powers of two, each taken while the point before lies below."""
    table = F.array(*[F.lit(p) for p in points])
    jumps = [2 ** i for i in reversed(range(len(points).bit_length()))]

    def jump(low, width):
        point = F.get(table, low + width - 1)
        return low + F.when(_above(value, point, right), width).otherwise(0)

    return F.aggregate(F.array(*[F.lit(j) for j in jumps]), F.lit(0), jump)
