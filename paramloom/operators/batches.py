"""Mini-batches over a table, with and without a seeded shuffle per epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paramloom.operators import ordering
from paramloom.operators.ordering import ROWS_PER_BLOCK, id_blocks, range_blocks


def shuffle_key(epoch: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", epoch.cast("string"), row_id.cast("string")))


def minibatches(df: DataFrame, row_id: str, batchsize: int,
                rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``batch``: one pass in the order of a whole-number id, unshuffled.

    The position counts over the whole table without sorting it in one task.
    """
    order = F.col(row_id)
    numbered = ordering.number_rows(df, [], [order], id_blocks(order, rows_per_block),
                                    "__pos", first=0)
    return numbered.withColumn("batch", ordering.whole(F.col("__pos"), batchsize)).drop("__pos")


def epoch_batches(df: DataFrame, row_id: str, epochs: int, batchsize: int) -> DataFrame:
    """Adds ``epoch`` from 1 and ``batch``: every row once per epoch, reshuffled.

    The order is a hash of epoch and id; ids are unique and not NULL. Only epochs and ids are numbered; the rows'
    other columns are joined by id afterwards.
    """
    copies = df.select(row_id).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))) \
        .withColumn("__key", shuffle_key(F.col("epoch"), F.col(row_id)))
    numbered = ordering.number_rows(copies, ["epoch"], [F.col("__key"), F.col(row_id)],
                                    range_blocks(), "__pos", first=0)
    batched = numbered.select(row_id, "epoch", ordering.whole(
        F.col("__pos"), batchsize).alias("batch"))
    return df.join(batched, row_id)
