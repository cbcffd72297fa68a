"""k-fold evaluation: folds x fold counts, from per-fold totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold_of(row_id: Column, folds: Column) -> Column:
    return F.pmod(row_id, folds)


def fold_rows(df: DataFrame, row_id: str, folds: int) -> DataFrame:
    """Every row once per fold, marked ``train`` or ``test``.

    A single fold trains and tests on all rows.
    """
    if folds == 1:
        sides = F.array(F.struct(F.lit(0).alias("fold"), F.lit("train").alias("part")),
                        F.struct(F.lit(0).alias("fold"), F.lit("test").alias("part")))
    else:
        own = fold_of(F.col(row_id), F.lit(folds)).cast("int")
        sides = F.transform(
            F.sequence(F.lit(0), F.lit(folds - 1)),
            lambda f: F.struct(f.alias("fold"),
                               F.when(f == own, "test").otherwise("train").alias("part")))
    return df.select("*", F.inline(sides))


def threshold_metric(df: DataFrame, row_id: str, score: str, target: str,
                     fold_counts: list[int]) -> DataFrame:
    """``(nfolds, fold, threshold, n_test, accuracy)`` of the rule score > threshold.

    The threshold is the mean score of the training folds: the total minus the fold's
    own sum. So training needs no copy of a row per fold, and only one row per fold
    (as many as listed in ``fold_counts``) is sent to the evaluation. A fold that holds
    all rows leaves none to train on: its threshold and accuracy are NULL.
    """
    counts = F.array(*[F.lit(k) for k in fold_counts])
    rows = df.select(row_id, score, target).withColumn("nfolds", F.explode(counts)) \
        .withColumn("fold", fold_of(F.col(row_id), F.col("nfolds")).cast("int"))
    sums = rows.groupBy("nfolds", "fold").agg(
        F.sum(score).alias("s"), F.count(score).alias("n"))
    every_fold = Window.partitionBy("nfolds")
    # A single fold is its own training set.
    left_out = (F.col("nfolds") > 1).cast("int")
    trained = sums.select("nfolds", "fold", (
        (F.sum("s").over(every_fold) - F.col("s") * left_out)
        / F.nullif(F.sum("n").over(every_fold) - F.col("n") * left_out, F.lit(0))
    ).alias("threshold"))
    # sum(fold_counts) rows, a number fixed by the caller.
    judged = rows.join(F.broadcast(trained), ["nfolds", "fold"])
    right = (F.col(score) > F.col("threshold")).cast("int") == F.col(target)
    return judged.groupBy("nfolds", "fold").agg(
        F.first("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("n_test"),
        F.avg(right.cast("int")).alias("accuracy"))
