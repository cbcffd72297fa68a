"""Ordered computations within a key that never put a hot key into one task.

A plain window sorts all rows of a key in one task, which fails for a key that holds a
third of the data. So every key is cut into ordered blocks, whatever its size:

1. one value per (key, block) is aggregated, map-side first;
2. a window over those few rows gives what each block inherits from the earlier
   ones of its key;
3. that inheritance goes back in as a *head* row in front of each block, and the
   ordered computation runs per (key, block).

The plan is the same for any data and nothing runs while it is built. The input is read
twice, once for the blocks' values. Ranges read it twice more, for its length and for a sample
by hash: a row's block is a function of the row and the bounds, so that rows and heads are cut
alike whatever columns each of them needs. NULL keys are handled like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BLOCK = 1 << 17
# Blocks of blocks hold so many; as many levels as numbers of 63 bits need.
FAN = 1 << 16
_LEVELS = 4
# Rows sampled for each bound of a range.
SAMPLED = 200

_BLOCK, _HEAD, _CARRY = "__block", "__head", "__carry"
_BOUNDS, _PLACE = "__bounds", "__place"


@dataclass(frozen=True)
class Blocks:
    """How keys are cut: by ``of``, the block of a row, or by ranges of the order itself.

    ``of`` must rise with the order.
    """

    of: Column | None = None


def whole(number: Column, by: int) -> Column:
    """Whole-number quotient, exact for any 64-bit number."""
    return F.call_function("div", number, F.lit(by))


def id_blocks(order: Column, rows: int = ROWS_PER_BLOCK) -> Blocks:
    """Blocks of a whole-number order that is unique within its key.

    Uniqueness bounds a (key, block) group by ``rows``.
    """
    return Blocks(whole(order, rows))


def range_blocks() -> Blocks:
    """Blocks of any order: ranges of (key, order) with about equally many rows.

    There are as many as the session shuffles into. Rows that tie in the first column of
    the order are parted by the others. The order rises, NULL first.
    """
    return Blocks()


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: Blocks) -> DataFrame:
    """``df`` with the block of each row."""
    if blocks.of is not None:
        return df.withColumn(_BLOCK, blocks.of)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[F.col(k) for k in keys], *order)
    bounds = _bounds(df, place, n).scalar()
    jumps = [2 ** i for i in reversed(range(n.bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(j) for j in jumps]), F.lit(0),
        lambda at, jump: F.when(F.get(_BOUNDS, at + jump - 1) <= F.col(_PLACE), at + jump).otherwise(at))
    return (df.withColumns({_BOUNDS: bounds, _PLACE: place})
            .withColumn(_BLOCK, found).drop(_BOUNDS, _PLACE))


def _bounds(df: DataFrame, place: Column, n: int) -> DataFrame:
    """One row: up to ``n - 1`` places that part ``df`` about evenly, sorted."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    share = F.pmod(F.xxhash64(place), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sample = (df.select(place.alias(_PLACE), share.alias("__share"))
              .where(F.col("__share") * total < float(SAMPLED * n)).select(_PLACE).distinct())
    ordered = sample.agg(F.array_sort(F.collect_list(_PLACE)).alias("all"))
    steps = F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
    return ordered.select(F.array_distinct(F.filter(F.transform(
        steps, lambda i: F.get("all", F.floor(i * F.size("all") / n).cast("int"))),
        lambda bound: bound.isNotNull())).alias(_BOUNDS))


def _with_heads(rows: DataFrame, keys: Sequence[str], combine, inherit) -> DataFrame:
    """``rows`` plus one head row per (key, block) that inherits something."""
    totals = rows.groupBy(*keys, _BLOCK).agg(combine(F.col(_CARRY)).alias(_CARRY))
    earlier = (Window.partitionBy(*keys).orderBy(_BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))
    heads = (totals.withColumn(_CARRY, inherit(F.col(_CARRY)).over(earlier))
             .where(F.col(_CARRY).isNotNull())
             .withColumn(_HEAD, F.lit(1)))
    return rows.withColumn(_HEAD, F.lit(0)).unionByName(heads, allowMissingColumns=True)


def _block_window(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys, _BLOCK).orderBy(F.col(_HEAD).desc(), *order)


def _drop_heads(df: DataFrame) -> DataFrame:
    return df.where(F.col(_HEAD) == 0).drop(_BLOCK, _HEAD, _CARRY)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: Blocks,
            value: Column, name: str, function) -> DataFrame:
    """``function`` over ``value`` from the first row of the key up to the current one.

    The function must give the same whether it sees values or what it made of groups of
    them, like sum, min or bit_xor.
    """
    rows = _cut(df, keys, order, blocks)
    scanned = _with_heads(rows.withColumn(_CARRY, value), keys, function, function)
    window = _block_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return _drop_heads(scanned.withColumn(name, function(_CARRY).over(window)))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: Blocks,
                value: Column, name: str) -> DataFrame:
    """``sum(value)`` from the first row of the key up to the current one."""
    return running(df, keys, order, blocks, value, name, F.sum)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: Blocks,
                name: str, first: int = 1) -> DataFrame:
    """Position of each row within its key, starting at ``first``."""
    one = F.lit(1).cast("bigint")
    numbered = running_sum(df, keys, order, blocks, one, name)
    return numbered if first == 1 else numbered.withColumn(name, F.col(name) + (first - 1))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: Blocks,
             value: Column, name: str, rising: bool = False) -> DataFrame:
    """``value`` of the row before, NULL for the first row of the key.

    ``value`` must not be NULL. ``rising`` says that it never falls along the order,
    which makes the last value of a block its maximum.
    """
    rows = _cut(df, keys, order, blocks)
    scanned = _with_heads(rows.withColumn(_CARRY, value), keys,
                          F.max if rising else lambda c: F.max_by(c, F.struct(*order)),
                          lambda column: F.last(column, ignorenulls=True))
    return _drop_heads(scanned.withColumn(name, F.lag(_CARRY).over(_block_window(keys, order))))


def with_totals(df: DataFrame, keys: Sequence[str], blocks: Blocks,
                values: dict[str, Column]) -> DataFrame:
    """Adds the sum of each value over the whole key to every row of it."""
    rows = _cut(df, keys, [], blocks)
    whole_key = Window.partitionBy(*keys)
    sums = {name: f"__sum_{name}" for name in values}
    totals = rows.groupBy(*keys, _BLOCK).agg(
        *[F.sum(value).alias(sums[name]) for name, value in values.items()])
    heads = totals.select(*keys, _BLOCK, F.lit(1).alias(_HEAD),
                          *[F.sum(s).over(whole_key).alias(s) for s in sums.values()])
    both = rows.withColumn(_HEAD, F.lit(0)).unionByName(heads, allowMissingColumns=True)
    window = _block_window(keys, []).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumns({name: F.first(total, ignorenulls=True).over(window)
                              for name, total in sums.items()})
    return known.where(F.col(_HEAD) == 0).drop(_BLOCK, _HEAD, *sums.values())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Small rows that each stand for much work, dealt out to all tasks.

    The number of partitions is given, as Spark would merge partitions that are small
    in bytes. Without keys rows are dealt out one by one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def position_blocks(df: DataFrame, count: Column, keys: Sequence[str],
                    block: int | Column = 1 << 16) -> DataFrame:
    """Every row once per block of positions, with the block's first and last as ``__low, __high``.

    Positions run from 0 to ``count - 1``. Blocks are spread over all tasks, as one row may stand
    for most of the output. Blocks of blocks come first, each an array of ``FAN`` numbers at
    most, so that no array grows with ``count``.
    """
    n = F.col("__count")
    block = F.lit(block) if isinstance(block, int) else block
    blocks = df.withColumns({"__count": count.cast("bigint"), "__size": block.cast("bigint")})
    blocks = blocks.where(n > 0).withColumn(_BLOCK, F.lit(0).cast("bigint"))
    last = F.call_function("div", n - 1, F.col("__size"))
    for level in reversed(range(_LEVELS)):
        low = F.col(_BLOCK) * FAN
        high = F.least(low + (FAN - 1), F.call_function("div", last, F.lit(FAN ** level)))
        blocks = blocks.withColumn(_BLOCK, F.explode(F.sequence(low, high)))
    low = F.col(_BLOCK) * F.col("__size")
    return spread(blocks, *keys, _BLOCK).withColumns({
        "__low": low, "__high": F.least(n - low, F.col("__size")) + low - 1}).drop(
        "__count", "__size", _BLOCK)


def positions(df: DataFrame, count: Column, name: str, keys: Sequence[str],
              block: int = 1 << 16) -> DataFrame:
    """Every row once per position 0 to ``count - 1``, produced block by block."""
    blocks = position_blocks(df, count, keys, block)
    return blocks.withColumn(name, F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key.

    Spark cuts each map task's share of a key to ``n`` rows before the shuffle
    (the rank limit of a window), so a hot key costs ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[column.desc() for column in order])
    return df.withColumn("__rank", F.row_number().over(window)) \
        .where(F.col("__rank") <= n).drop("__rank")
