"""Grids: all combinations of parameter values, last parameter fastest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paramloom.functions.params import RULE, dictionary_text, task_id, value_at
from paramloom.operators import ordering

# Combinations of one block, which are spread over the tasks, and of one array within a task.
BLOCK, PIECE = 1 << 16, 1 << 12


def _as_dimensions(values: DataFrame) -> DataFrame:
    """Parameters as ``items`` (a list) or ``rule`` (an interval), with their number of values."""
    if "rule" in values.columns:
        return values
    return values.withColumnsRenamed({"values": "items"}).withColumns({
        "n": F.size("items").cast("bigint"), "rule": F.lit(None).cast(RULE)})


def dimensions(values: DataFrame) -> DataFrame:
    """One row per spec: ordered parameters, stride of each, number of combinations.

    ``values`` has lists as ``values``, or is what ``param_dimensions`` gives. ``combinations``
    is NULL beyond 2^63-1. A spec is one parsed document, which bounds what is gathered per
    group; an interval takes as little room as a number.
    """
    dims = F.array_sort(F.collect_list(F.struct("ord", "param", "items", "n", "rule")))
    sizes = F.transform("dims", lambda d: d["n"])
    one, too_many = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")

    def multiply(products, n):
        """Puts the next running product in front, from the last parameter to the first."""
        product = F.get(products, F.lit(0))
        longer = F.when(product > 0, F.coalesce(F.try_multiply(product, n), too_many))
        return F.concat(F.array(F.coalesce(longer, too_many)), products)

    products = F.aggregate(F.reverse(sizes), F.array(one), multiply)
    total = F.get("__products", F.lit(0))
    return (_as_dimensions(values).groupBy("spec_id").agg(dims.alias("dims"))
            .withColumn("__products", products)
            .select("spec_id", "dims",
                    F.slice("__products", 2, F.size("dims")).alias("strides"),
                    F.when(total > 0, total).alias("combinations")))


def cardinality(values: DataFrame) -> DataFrame:
    """``(spec_id, combinations)`` without building the grid."""
    return dimensions(values).select("spec_id", "combinations")


def _decode(dims: Column, strides: Column, combo_id: Column) -> Column:
    return F.zip_with(dims, strides, lambda dim, stride: value_at(
        dim["items"], dim["rule"], F.call_function("div", combo_id, stride) % dim["n"]))


def grid(values: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``(spec_id, combo_id, params MAP)``: every combination of every spec.

    Combination numbers are decoded as mixed-radix numbers, so nothing is joined. They are
    produced in blocks spread over the cluster, as one spec may hold most combinations. A block's
    row carries the spec's parameters once and a combination none of them: intervals are rules,
    and a spec with long lists has blocks of as many combinations as it lists values, so that
    what is shuffled stays in proportion to the combinations.
    """
    listed = F.aggregate("dims", F.lit(0).cast("bigint"),
                         lambda total, d: total + F.coalesce(F.size(d["items"]), F.lit(0)))
    blocks = ordering.position_blocks(dimensions(values), F.col("combinations"), ["spec_id"],
                                      F.greatest(listed, F.lit(block)))
    span = F.col("__high") - F.col("__low")
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), ordering.whole(span, piece)),
                         lambda i: F.col("__low") + i * piece)
    pieces = blocks.withColumn("__from", F.explode(starts))
    ids = F.sequence(F.col("__from"), F.least(F.col("__from") + (piece - 1), F.col("__high")))
    made = F.transform(ids, lambda i: F.struct(i.alias("combo_id"), F.map_from_arrays(
        F.transform("dims", lambda d: d["param"]),
        _decode(F.col("dims"), F.col("strides"), i)).alias("params")))
    return pieces.select("spec_id", F.inline(made))


def grid_by_folding(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(spec_id, combo_id, combination ARRAY)``: one parameter after the other.

    Each step extends every combination so far by each value of the next parameter;
    a missing next parameter leaves it as it is. There is a step for each parameter of
    the longest spec, whose length is asked for first. The last step, which produces most
    rows, is spread over all tasks in blocks. Rows carry only the parameters still to come.
    Specs beyond 2^63-1 combinations have none.
    """
    parameters = values.groupBy("spec_id").count().agg(F.max("count")).first()[0] or 0
    rows = dimensions(values).where(F.col("combinations").isNotNull()).select(
        "spec_id", "dims", F.lit(0).cast("bigint").alias("combo_id"),
        F.array().cast("array<string>").alias("combination"))
    for position in range(parameters):
        side = F.get(F.col("dims"), F.lit(0))
        rows = rows.withColumns({"__dim": side, "dims": F.slice("dims", 2, parameters)})
        n = F.when(F.col("__dim").isNull(), 1).otherwise(F.col("__dim.n"))
        if position and position == parameters - 1:
            rows = ordering.positions(rows, n, "__pos", ["spec_id", "combo_id"], block)
        else:
            zero = F.lit(0).cast("bigint")
            rows = rows.withColumn("__part", F.explode(F.when(
                n > 0, F.sequence(zero, ordering.whole(n - 1, PIECE))))).withColumn(
                "__pos", F.explode(F.sequence(F.col("__part") * PIECE, F.least(
                    F.col("__part") * PIECE + (PIECE - 1), n - 1)))).drop("__part")
        value = value_at(F.col("__dim.items"), F.col("__dim.rule"), F.col("__pos"))
        rows = rows.select(
            "spec_id", "dims", (F.col("combo_id") * n + F.col("__pos")).alias("combo_id"),
            F.when(F.col("__dim").isNull(), F.col("combination"))
            .otherwise(F.concat("combination", F.array(value))).alias("combination"))
    return rows.drop("dims")


def grid_range(spark: SparkSession, dims: dict[str, list], partitions: int | None = None
               ) -> DataFrame:
    """Grid of typed columns for parameters written down in the program.

    ``spark.range`` plus arithmetic per column: no shuffle, and a filter on the
    parameters runs in the same stage.
    """
    total = 1
    for name, options in dims.items():
        if not options:
            raise ValueError(f"parameter {name} has no values")
        total *= len(options)
    if total >= 2 ** 63:
        raise ValueError(f"{total} combinations exceed the range of a row number")
    stride, columns = total, []
    for name, options in dims.items():
        stride //= len(options)
        digit = F.call_function("div", F.col("combo_id"), F.lit(stride)) % len(options)
        table = F.array(*[F.lit(v) for v in options])
        columns.append(F.get(table, digit.cast("int")).alias(name))
    ids = spark.range(0, total, 1, partitions) if partitions else spark.range(total)
    return ids.withColumnRenamed("id", "combo_id").select("combo_id", *columns)


def concat_values(left: Column, right: Column) -> Column:
    """Joins two combinations given as arrays."""
    return F.concat(left, right)


def tasks(combinations: DataFrame) -> DataFrame:
    """``(task_id, spec_id, combo_id, params)`` with a repeatable id."""
    return combinations.select(
        task_id(F.col("spec_id"), F.col("combo_id"), F.col("params")).alias("task_id"),
        "spec_id", "combo_id", "params")


def with_params_text(combinations: DataFrame) -> DataFrame:
    return combinations.withColumn("params_text", dictionary_text(F.col("params")))


def carry_forward(df: DataFrame, run: str, position: str, delta: str, base: int,
                  name: str = "n", rows_per_block: int = ordering.ROWS_PER_BLOCK) -> DataFrame:
    """Parameter that builds on the one before: ``n_c = n_(c-1) + delta_c``."""
    summed = ordering.running_sum(
        df, [run], [F.col(position)], ordering.id_blocks(F.col(position), rows_per_block),
        F.col(delta).cast("bigint"), name)
    return summed.withColumn(name, F.col(name) + F.lit(base))
