"""Epoch logs, training reports, series for curves, options with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paramloom.functions.params import with_default

# The options of the training task, their defaults and types.
OPTIONS = {
    "batchsize": ("100", "int"),
    "epoch": ("20", "int"),
    "gpu": ("-1", "int"),
    "out": ("result", "string"),
    "resume": ("", "string"),
    "unit": ("1000", "int"),
}

SERIES = ["main_loss", "validation_main_loss", "main_accuracy", "validation_main_accuracy"]


def options(combinations: DataFrame, params: str = "params", wrong: str | None = None
            ) -> DataFrame:
    """One typed column per training option; a missing one has its default.

    A value that is none of its type is NULL; ``wrong`` names a column that lists such options.
    """
    typed = {name: with_default(F.col(params), name, default, dtype)
             for name, (default, dtype) in OPTIONS.items()}
    rows = combinations.select(
        *[c for c in combinations.columns if c != params],
        *[column.alias(name) for name, column in typed.items()])
    if wrong is None:
        return rows
    return rows.withColumn(wrong, F.array_compact(F.array(*[
        F.when(F.col(name).isNull(), F.lit(name)) for name in OPTIONS])))


def evaluate(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean loss and accuracy of the validation rows per epoch, weighted by row."""
    keys = keys or []
    return (observations.where(F.col("split") == "validation").groupBy(*keys, "epoch")
            .agg(F.avg("loss").alias("loss"), F.avg("acc").alias("accuracy"),
                 F.count(F.lit(1)).alias("n_rows")))


def epoch_log(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of each observed value per epoch and split."""
    return observations.groupBy(*(keys or []), "epoch", "split").agg(
        F.avg("loss").alias("loss"), F.avg("acc").alias("accuracy"))


def _seconds(gap: Column) -> Column:
    return gap.cast("interval second").cast("decimal(20,6)").cast("double")


def report(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Epoch, losses and accuracies of both splits, seconds since the run began.

    The window sees one row per epoch of a run.
    """
    keys = keys or []

    def mean(column, split):
        return F.avg(F.when(F.col("split") == split, F.col(column)))

    per_epoch = observations.groupBy(*keys, "epoch").agg(
        mean("loss", "main").alias("main_loss"),
        mean("loss", "validation").alias("validation_main_loss"),
        mean("acc", "main").alias("main_accuracy"),
        mean("acc", "validation").alias("validation_main_accuracy"),
        F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    began = F.min("__first").over(Window.partitionBy(*keys))
    return per_epoch.select(*keys, "epoch", *SERIES,
                            _seconds(F.col("__last") - began).alias("elapsed_time"))


def series(reported: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long form ``(epoch, series, value)``."""
    return reported.unpivot([*(keys or []), "epoch"], SERIES, "series", "value")
