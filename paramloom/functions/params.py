"""Expressions for parameter values, intervals and parameter dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Interval arithmetic is exact: 12 decimals, and operand widths chosen so that
# start + i * step keeps all of them (Spark trims the scale above 38 digits).
BOUND = "decimal(37,12)"
STEP = "decimal(26,12)"
INDEX = "decimal(10,0)"
# Bounds and steps from here on, and intervals of more values, are no parameters.
LARGEST_BOUND = 10 ** 13
MOST_VALUES = 10_000_000


def number_text(value: Column) -> Column:
    """Decimal of 12 places as text without trailing zeros: 0.300 -> 0.3, 15.000 -> 15.

    Put together from its digits, as the text of a small decimal depends on the session.
    """
    size = F.abs(value)
    whole = F.floor(size)
    digits = ((size - whole) * 10 ** 12).cast("bigint").cast("string")
    places = F.rtrim(F.lpad(digits, 12, "0"), F.lit("0"))
    return F.concat(F.when(value < 0, "-").otherwise(""), whole.cast("bigint").cast("string"),
                    F.when(places != "", F.concat(F.lit("."), places)).otherwise(""))


def whole_length(start: Column, stop: Column, step: Column) -> Column:
    """Number of values in the half-open interval of ``bigint`` bounds; 0 if empty or step 0."""
    up = F.call_function("div", stop - start - 1, F.when(step != 0, step)) + 1
    down = F.call_function("div", stop - start + 1, F.when(step != 0, step)) + 1
    return (F.when((step > 0) & (stop > start), up).when((step < 0) & (stop < start), down)
            .otherwise(F.lit(0)).cast("bigint"))


def whole_values(start: Column, step: Column, length: Column) -> Column:
    """``length`` values from ``start`` as ``ARRAY<STRING>``, all of them ``bigint``."""
    # sequence() is inclusive and raises on reversed bounds, hence the guard.
    some = length > 0
    first, by = F.when(some, start), F.when(some, step)
    return F.coalesce(F.sequence(first, first + (length - 1) * by, by).cast("array<string>"),
                      F.array().cast("array<string>"))


def interval_length(start: Column, stop: Column, step: Column) -> Column:
    """Number of values in the half-open interval; 0 if it is empty or step is 0.

    Whole quotient plus remainder test instead of ``ceil`` of a rounded division.
    """
    span = stop - start
    runs = ((step > 0) & (span > 0)) | ((step < 0) & (span < 0))
    whole = F.call_function("div", span, F.when(step != 0, step))
    partial = F.when(span % F.when(step != 0, step) != 0, F.lit(1)).otherwise(F.lit(0))
    return F.when(runs, whole + partial).otherwise(F.lit(0)).cast("bigint")


def interval_values(start: Column, stop: Column, step: Column,
                    length: Column | None = None) -> Column:
    """Values of ``[start, stop)`` as ``ARRAY<STRING>``, counting down for a negative step.

    ``length`` is the number of values, where already known. Bounds and steps must be below
    ``LARGEST_BOUND``.
    """
    start, stop, step = start.cast(BOUND), stop.cast(BOUND), step.cast(STEP)
    n = interval_length(start, stop, step) if length is None else length
    some = n > 0
    positions = F.when(some, F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))))
    return F.coalesce(
        F.transform(positions, lambda i: number_text(start + i.cast(INDEX) * step)),
        F.array().cast("array<string>"),
    )


#: An interval as a rule: whole numbers by ``first`` and ``by``, others by ``start`` and ``step``.
RULE = f"struct<whole: boolean, first: bigint, by: bigint, start: {BOUND}, step: {STEP}>"


def value_at(items: Column, rule: Column, position: Column) -> Column:
    """Text of the value at ``position`` (from 0): of a list, or of an interval's rule."""
    whole = (rule["first"] + position * rule["by"]).cast("string")
    broken = number_text(rule["start"] + position.cast(INDEX) * rule["step"])
    return (F.when(rule.isNull(), F.get(items, position.cast("int")))
            .when(rule["whole"], whole).otherwise(broken))


def overlay(base: Column, names: Column, top: Column) -> Column:
    """Base dictionary under ``top``; a name in ``names`` is taken from ``top``."""
    return F.map_concat(
        F.map_filter(base, lambda k, _: ~F.array_contains(names, k)), top)


def dictionary_text(params: Column, sep: str = ",") -> Column:
    """Dictionary as sorted ``k=v`` text, comparable across engines."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(params),
                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))),
        sep)


def options_text(params: Column, prefix: str = "") -> Column:
    """``--name value`` for every entry; a flag (empty value) gives ``--name`` alone."""
    options = F.transform(
        F.map_entries(params),
        lambda e: F.concat(F.lit("--"), e["key"],
                           F.when(e["value"] == "", F.lit(""))
                           .otherwise(F.concat(F.lit(" "), e["value"]))))
    text = F.array_join(options, " ")
    return F.concat_ws(" ", F.lit(prefix), text) if prefix else text


def to_json(params: Column) -> Column:
    return F.to_json(params)


def from_json(text: Column, passthrough: Column | None = None) -> Column:
    """JSON text to a dictionary; ``passthrough`` is used where it is already decoded."""
    decoded = F.from_json(text, "map<string,string>")
    return decoded if passthrough is None else F.coalesce(passthrough, decoded)


def task_id(spec_id: Column, combo_id: Column, params: Column) -> Column:
    """Deterministic task id, so that a retried task keeps its identity."""
    return F.sha2(F.concat_ws("\u0001", spec_id, combo_id.cast("string"),
                              dictionary_text(params)), 256)


def with_default(params: Column, name: str, default: str, dtype: str) -> Column:
    """Option ``name`` out of ``params`` as ``dtype``, or its default; NULL if it is none."""
    return F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(default)).try_cast(dtype)
