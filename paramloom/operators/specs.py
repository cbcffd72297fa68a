"""Parameter specifications: classify, reject, expand to values.

Input rows are what the reader gives, one per parameter:
``(spec_id, ord, param, type, items ARRAY<STRING>, nested BOOLEAN)`` with ``type``
one of list, tuple, bool, str, int, float, dict or another type name.

A parameter that can hold no values (dictionary, null, date ...) is left out and
reported; a parameter that would distort the grid (short, empty, nested, step 0,
not a number, beyond the range of exact arithmetic, too many values) rejects its whole
spec. So do a name that two documents share, and more than 2^63-1 combinations; both are
reported without a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paramloom.functions.params import (BOUND, LARGEST_BOUND, MOST_VALUES, STEP,
                                        interval_length, value_at, whole_length)
from paramloom.operators import ordering

SKIPPED = ["dict", "type", "unreadable"]


def classify(raw: DataFrame, list_as_interval: bool = False) -> DataFrame:
    """Adds ``kind``: list, interval, flag, scalar, dict or other.

    ``list_as_interval`` reads a list ``[start, end, step?]`` as an interval.
    """
    kind = (
        F.when(F.col("type") == "list", F.lit("interval" if list_as_interval else "list"))
        .when(F.col("type") == "tuple", F.lit("interval"))
        .when(F.col("type") == "bool", F.lit("flag"))
        .when(F.col("type").isin("str", "int", "float"), F.lit("scalar"))
        .when(F.col("type") == "dict", F.lit("dict"))
        .otherwise(F.lit("other")))
    return raw.withColumn("kind", kind)


def _item(position: int, default: str | None = None) -> Column:
    item = F.get(F.col("items"), F.lit(position))
    return item if default is None else F.coalesce(item, F.lit(default))


def _with_bounds(classified: DataFrame) -> DataFrame:
    """Adds start, end, step (default 1) and length of intervals, parsed once.

    Whole numbers, nearly all of them, are ``bigint``; other intervals are decimals.
    """
    interval = F.col("kind") == "interval"
    texts = {"__start": _item(0), "__stop": _item(1), "__step": _item(2, "1")}
    whole = interval
    for text in texts.values():
        whole = whole & F.coalesce(text.rlike(r"^-?[0-9]{1,13}$"), F.lit(False))
    parsed = classified.withColumn("__whole", whole)
    parsed = parsed.withColumns(
        {f"{n}_w": F.when(F.col("__whole"), t.cast("bigint")) for n, t in texts.items()}
        | {n: F.when(interval & ~F.col("__whole"), t.try_cast(BOUND)) for n, t in texts.items()})
    near = F.lit(True)
    for n in texts:
        near = near & (F.abs(F.col(n)) < LARGEST_BOUND)
    length = (F.when(F.col("__whole"), whole_length(*(F.col(f"{n}_w") for n in texts)))
              .when(near, interval_length(*(F.col(n) for n in texts))))
    return parsed.withColumn("__near", F.col("__whole") | near).withColumn("__length", length)


def _reason() -> Column:
    interval = F.col("kind") == "interval"
    empty = F.size("items") == 0
    unknown = ~F.col("__whole") & (
        F.col("__start").isNull() | F.col("__stop").isNull() | F.col("__step").isNull())
    step = F.coalesce(F.col("__step_w").cast(BOUND), F.col("__step"))
    return (
        F.when(F.col("type") == "unreadable", F.lit("unreadable"))
        .when(F.col("kind") == "dict", F.lit("dict"))
        .when(F.col("kind") == "other", F.lit("type"))
        .when((F.col("kind") == "list") & empty, F.lit("empty"))
        .when(F.col("nested"), F.lit("nested"))
        .when(interval & (F.size("items") < 2), F.lit("short"))
        .when(interval & unknown, F.lit("number"))
        .when(interval & (step == 0), F.lit("step"))
        .when(interval & ~F.col("__near"), F.lit("range"))
        .when(interval & (F.col("__length") == 0), F.lit("empty"))
        .when(interval & (F.col("__length") > MOST_VALUES), F.lit("too_many")))


_BOUNDS = ["__whole", "__start", "__stop", "__step", "__start_w", "__stop_w", "__step_w",
           "__near", "__length"]


def with_reason(classified: DataFrame) -> DataFrame:
    """Adds ``reason``, NULL for a good parameter."""
    return _with_bounds(classified).withColumn("reason", _reason()).drop(*_BOUNDS)


def spec_errors(raw: DataFrame, list_as_interval: bool = False) -> DataFrame:
    """``(spec_id, param, reason)`` of every parameter or whole spec that was not taken."""
    checked = _checked(raw, list_as_interval)
    reason = F.when(F.col("repeated"), "repeated").when(F.col("combinations").isNull(), "too_many")
    whole = _by_spec(checked).where(~F.col("bad")).select(
        "spec_id", F.lit(None).cast("string").alias("param"), reason.alias("reason"))
    return (checked.select("spec_id", "param", "reason").unionByName(whole)
            .where(F.col("reason").isNotNull()))


def _items() -> Column:
    """Listed values: NULL for an interval, none for a false flag, an empty text for a true one."""
    return (F.when(F.col("kind") == "flag",
                   F.when(_is_off(), F.array().cast("array<string>")).otherwise(F.array(F.lit(""))))
            .when(F.col("kind") != "interval", F.col("items")))


def _count() -> Column:
    """Number of values; NULL for an interval that is none or has too many."""
    inside = F.when(F.col("__length") <= MOST_VALUES, F.col("__length"))
    return F.when(F.col("kind") == "interval", inside).otherwise(F.size(_items())).cast("bigint")


def _rule() -> Column:
    return F.when(F.col("kind") == "interval", F.struct(
        F.col("__whole").alias("whole"), F.col("__start_w").alias("first"),
        F.col("__step_w").alias("by"), F.col("__start").alias("start"),
        F.col("__step").cast(STEP).alias("step")))


def _is_off() -> Column:
    return (F.col("kind") == "flag") & (F.get(F.col("items"), F.lit(0)) != "True")


def expand_values(classified: DataFrame) -> DataFrame:
    """Adds ``items``, ``n`` and ``rule``: the values in declared order, not yet written out.

    ``n`` says how many; a list has them as ``items``, an interval as a rule. A false flag has
    none, and an interval that can't be taken has NULL.
    """
    bounds = _with_bounds(classified)
    return bounds.withColumns({"n": _count(), "rule": _rule(), "items": _items()}).drop(*_BOUNDS)


def _checked(raw: DataFrame, list_as_interval: bool) -> DataFrame:
    return _with_bounds(classify(raw, list_as_interval)).withColumn("reason", _reason())


def _by_spec(checked: DataFrame) -> DataFrame:
    """One row per spec: whether it is bad or told twice, what is taken of it, combinations.

    A spec is one parsed document, which bounds what is gathered. Parameters of a document are
    numbered from 1, so more parameters than the last number mean several documents.
    """
    reason = F.col("reason")
    bad = reason.isNotNull() & ~reason.isin(SKIPPED)
    taken = F.when(reason.isNull() & ~_is_off(), F.struct(
        "ord", "param", "kind", _items().alias("items"), _count().alias("n"),
        _rule().alias("rule")))
    by_spec = checked.groupBy("spec_id").agg(
        F.max(bad).alias("bad"), F.collect_list(taken).alias("taken"),
        (F.count_if(F.col("ord") > 0) > F.max("ord")).alias("repeated"))
    combinations = F.aggregate("taken", F.lit(1).cast("bigint"), lambda product, t:
                               F.try_multiply(product, t["n"]))
    return by_spec.withColumn("combinations", combinations)


def param_dimensions(raw: DataFrame, list_as_interval: bool = False) -> DataFrame:
    """``(spec_id, ord, param, kind, items, n, rule)`` of the good specs, ready for a grid.

    Intervals stay rules (first value, step, number), however many values they stand for.
    """
    good = _by_spec(_checked(raw, list_as_interval)).where(
        ~F.col("bad") & ~F.col("repeated") & F.col("combinations").isNotNull())
    return good.select("spec_id", F.inline("taken"))


def param_values(raw: DataFrame, list_as_interval: bool = False) -> DataFrame:
    """``(spec_id, ord, param, kind, values)``: as ``param_dimensions``, values written out.

    Each row holds all values of its parameter: for small parameters, and to look at.
    """
    dimensions = param_dimensions(raw, list_as_interval)
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    values = F.transform(numbers, lambda i: value_at(F.col("items"), F.col("rule"), i))
    return dimensions.select("spec_id", "ord", "param", "kind", F.coalesce(
        F.when(F.col("rule").isNull(), F.col("items")), values,
        F.array().cast("array<string>")).alias("values"))


def value_rows(values: DataFrame) -> DataFrame:
    """Long form ``(spec_id, ord, param, pos, value)``, ``pos`` from 0.

    Values are produced in blocks spread over all tasks, as one interval may have most.
    """
    value = value_at(F.col("items"), F.col("rule"), F.col("pos"))
    placed = ordering.positions(values.select("spec_id", "ord", "param", "items", "n", "rule"),
                                F.col("n"), "pos", ["spec_id", "ord"])
    return placed.select("spec_id", "ord", "param", F.col("pos").cast("int").alias("pos"),
                         value.alias("value"))
