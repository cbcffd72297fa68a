"""One aggregate per parameter combination over a table, in a single pass.

``threshold_sweep`` covers combinations of comparisons (``column <= parameter``):
its cost does not grow with the number of combinations per row.
``parameter_sweep`` takes a grid read from files and any condition per parameter and value,
``predicate_sweep`` any condition per combination.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from paramloom.functions.buckets import search_sorted
from paramloom.operators.grid import grid_range

# Conditions that one plan may hold: values of all parameters together, not combinations.
MOST_CONDITIONS = 10_000


@dataclass(frozen=True)
class Threshold:
    """Parameter used as ``column op value``; op is one of <=, <, >=, >, =."""

    column: Column
    op: str
    values: list

    def __post_init__(self):
        if self.op not in ("<=", "<", ">=", ">", "="):
            raise ValueError(f"unknown comparison {self.op}")
        if not self.values or any(v is None for v in self.values):
            raise ValueError("a threshold needs values, none of them NULL")

    @property
    def points(self) -> list:
        return sorted(set(self.values))

    def possible(self) -> Column:
        """Rows that match at least one value; reaches the scan as a pushed filter."""
        low, high = F.lit(self.points[0]), F.lit(self.points[-1])
        return {
            "<=": lambda: self.column <= high, "<": lambda: self.column < high,
            ">=": lambda: self.column >= low, ">": lambda: self.column > low,
            "=": lambda: self.column.isin(self.points),
        }[self.op]()

    def rank(self) -> Column:
        """Rank of the value from which on (<, <=), down from which (>, >=) a row matches."""
        right = self.op in ("<", ">=")
        found = search_sorted(self.column, self.points, right=right)
        return found - 1 if self.op in (">=", ">") else found


@dataclass(frozen=True)
class Measure:
    """Aggregate ``how`` (count, sum, min, max, avg) of a column."""

    how: str
    column: Column | None = None


# Combinations that one task may add up; more are spread.
SMALL_GRID = 100_000

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _partials(measures: dict[str, Measure]) -> dict[str, tuple[str, Column]]:
    parts = {}
    for name, measure in measures.items():
        column = F.lit(1) if measure.column is None else measure.column
        kinds = ("sum", "count") if measure.how == "avg" else (measure.how,)
        for kind in kinds:
            parts[f"__{kind}_{name}"] = (kind, column)
    return parts


def threshold_sweep(facts: DataFrame, thresholds: dict[str, Threshold],
                    measures: dict[str, Measure]) -> DataFrame:
    """``(combo_id, <parameter>…, <measure>…)`` for the full grid of the values.

    Every row is put into the one cell of the grid where it starts to match, cells
    are aggregated (map-side first, at most one cell per combination), and running
    aggregates along each parameter turn cells into combinations. A combination
    that matches nothing keeps its row.
    """
    spark = facts.sparkSession
    ranks = {name: f"__rank_{name}" for name in thresholds}
    possible = F.lit(True)
    for threshold in thresholds.values():
        possible = possible & threshold.possible()
    parts = _partials(measures)

    cells = (
        facts.where(possible)
        .select(*[t.rank().alias(ranks[n]) for n, t in thresholds.items()],
                *[column.alias(part) for part, (_, column) in parts.items()])
        .groupBy(*ranks.values())
        .agg(*[getattr(F, kind)(part).alias(part) for part, (kind, _) in parts.items()]))

    # The grid in declared order, with the rank of each value.
    total = math.prod(len(t.values) for t in thresholds.values())
    positions = grid_range(spark, {n: list(range(len(t.values))) for n, t in thresholds.items()},
                           partitions=1 if total <= SMALL_GRID else None)
    columns = [F.col("combo_id")]
    for name, threshold in thresholds.items():
        order = [threshold.points.index(v) for v in threshold.values]
        columns += [_lookup(threshold.values, name).alias(name),
                    _lookup(order, name).alias(ranks[name])]
    declared = positions.select(*columns)

    # A value listed twice must not be added up twice.
    repeated = any(len(t.points) < len(t.values) for t in thresholds.values())
    every_cell = declared.select(*ranks.values()).distinct() if repeated else declared
    kept = every_cell.columns
    summed = every_cell.join(cells, list(ranks.values()), "left")
    for name, threshold in thresholds.items():
        if threshold.op == "=":
            continue
        rank = F.col(ranks[name])
        # One group holds one row per value of this parameter, a list in the program.
        along = (Window.partitionBy(*[r for n, r in ranks.items() if n != name])
                 .orderBy(rank.desc() if threshold.op in (">=", ">") else rank)
                 .rowsBetween(Window.unboundedPreceding, 0))
        summed = summed.select(*kept, *[
            _MERGE[kind](part).over(along).alias(part) for part, (kind, _) in parts.items()])
    if repeated:
        summed = declared.join(summed, list(ranks.values()), "left")
    return summed.select("combo_id", *thresholds, *_results(measures))


def _lookup(values: list, position: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(position))


def _results(measures: dict[str, Measure]) -> list[Column]:
    columns = []
    for name, measure in measures.items():
        if measure.how == "avg":
            count = F.col(f"__count_{name}")
            value = F.col(f"__sum_{name}") / F.when(count > 0, count)
        else:
            value = F.col(f"__{measure.how}_{name}")
            if measure.how == "count":
                value = F.coalesce(value, F.lit(0).cast("bigint"))
        columns.append(value.alias(name))
    return columns


# Choices that a row is given to at once; a row of more is added up with those of equal answers.
FEW_CHOICES = 32


def _matched(facts: DataFrame, dims: dict[str, list[Column]], measures: dict[str, Measure],
             prune: Callable[[DataFrame, list[str]], DataFrame] = lambda cells, names: cells
             ) -> DataFrame:
    """Partial measures per choice of one condition from each of ``dims``, by positions in its
    list; choices that no row matches are left out.

    A row is asked every condition once. One that few choices match is added to these at once,
    map-side, so that its answers are no key. Any other stands for its answers: rows of equal
    answers are added up map-side, and only those sums are given to conditions, dimension by
    dimension. Both go through the same shuffle.
    """
    parts = _partials(measures)
    asked = {name: f"__asked_{k}" for k, name in enumerate(dims)}
    # Each condition is a column of its own: rows of so many columns are made by small methods,
    # which the JVM optimises, unlike a long one that asks all conditions.
    answer = {name: [f"__asked_{k}_{i}" for i in range(len(dims[name]))]
              for k, name in enumerate(dims)}
    rows = facts.select(*[condition.alias(a) for name in dims
                          for condition, a in zip(dims[name], answer[name])],
                        *[column.alias(part) for part, (_, column) in parts.items()])
    # Positions of the conditions that hold; a row of many choices has them as its answers.
    held = {name: F.array_remove(F.array(*[F.when(F.col(a), position).otherwise(-1)
                                           for position, a in enumerate(answer[name])]), -1)
            for name in dims}
    choices = math.prod(F.size(held[name]).cast("double") for name in dims)
    cells = rows.select(*[held[name].alias(answers) for name, answers in asked.items()],
                        choices.alias("__choices"), *parts)
    few = F.col("__choices") <= FEW_CHOICES
    for name, answers in asked.items():
        # A row without choices is left with NULL, which is no position.
        cells = cells.withColumn(name, F.explode_outer(
            F.when(few, F.col(answers)).otherwise(F.array(F.lit(-1)))))
    cells = (
        cells.select(*dims, *[F.when(~few, F.col(answers)).alias(answers)
                              for answers in asked.values()], *parts)
        .groupBy(*dims, *asked.values())
        .agg(*[getattr(F, kind)(part).alias(part) for part, (kind, _) in parts.items()]))
    done: list[str] = []
    for name in dims:
        answers = asked.pop(name)
        position = F.explode(F.coalesce(answers, F.array(name)))
        done.append(name)
        later = [n for n in dims if n not in done]
        kept = [*[n for n in done if n != name], *later, *asked.values()]
        chosen = cells.select(*kept, *parts, position.alias(name))
        if asked:
            chosen = prune(chosen, done)
        cells = chosen.groupBy(*kept, name).agg(
            *[_MERGE[kind](part).alias(part) for part, (kind, _) in parts.items()])
    return cells


def predicate_sweep(facts: DataFrame, combinations: list[dict],
                    condition: Callable[[dict], Column],
                    measures: dict[str, Measure]) -> DataFrame:
    """``(combo_id, <measure>…)`` for any condition built from a combination.

    The facts are scanned once, whatever the number of combinations, and only the sums of rows
    that match the same combinations are given to these. The plan holds every condition; grids
    whose parameters have conditions of their own are for ``parameter_sweep``.
    """
    spark = facts.sparkSession
    every = spark.range(len(combinations)).withColumnRenamed("id", "combo_id")
    if not combinations:
        return every.select("combo_id", *[F.lit(None).alias(name) for name in measures])
    added = _matched(facts, {"combo_id": [condition(c) for c in combinations]}, measures)
    return every.join(added, "combo_id", "left").select("combo_id", *_results(measures))


def parameter_sweep(facts: DataFrame, grid: DataFrame,
                    conditions: dict[str, Callable[[str], Column]],
                    measures: dict[str, Measure]) -> DataFrame:
    """``(<id columns of the grid>…, <measure>…)`` for the combinations of ``grid`` rows.

    ``grid`` has a column ``params`` (map of texts) beside its ids. ``conditions`` gives, for a
    parameter, the condition that a value of it stands for; a combination matches the rows for
    which those of all its parameters hold. A parameter that a combination lacks, or has no
    condition, asks nothing. A combination that matches nothing keeps its row.

    The plan holds a condition per parameter and value, so these must be known while it is
    built (more than ``MOST_CONDITIONS`` are refused); combinations stay a table of any length.
    """
    if not conditions:
        raise ValueError("a sweep needs a condition")
    value = {name: F.col("params")[name] for name in conditions}
    listed = grid.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), v.alias("value")) for name, v in value.items()])
    ).alias("asked")).select("asked.*").distinct().limit(MOST_CONDITIONS + 1).collect()
    if len(listed) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} values for one plan")
    ids = [c for c in grid.columns if c != "params"]
    if not listed:  # no combinations
        return grid.select(*ids, *[F.lit(None).alias(name) for name in measures])
    dims: dict[str, list[Column]] = {}
    positions: list[Column] = []
    for k, (name, condition) in enumerate(conditions.items()):
        values = sorted((r["value"] for r in listed if r["name"] == name),
                        key=lambda v: (v is not None, v))
        dims[f"__value_{k}"] = [F.lit(True) if v is None else condition(v) for v in values]
        # A combination's value is known by its place in the list; a lacking one comes first.
        texts = F.from_json(F.lit(json.dumps([v for v in values if v is not None])), "array<string>")
        lacking = int(values[0] is None)
        positions.append(F.coalesce(F.array_position(texts, value[name]) - 1 + lacking, F.lit(0))
                         .cast("int").alias(f"__value_{k}"))
    wanted = grid.select(*ids, *positions)

    def prune(cells: DataFrame, names: list[str]) -> DataFrame:
        """Leaves choices out that no combination begins with; one value alone always does."""
        return cells if len(names) == 1 else cells.join(
            wanted.select(*names).distinct(), names, "left_semi")

    added = _matched(facts, dims, measures, prune)
    return wanted.join(added, list(dims), "left").select(*ids, *_results(measures))
