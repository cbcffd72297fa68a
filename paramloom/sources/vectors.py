"""Labelled vectors and training snapshots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from paramloom.operators.training import SNAPSHOT, State, Training


def labelled_split(rows: DataFrame, row_id: str, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; every ``every``-th id is a test row, in any run."""
    is_test = F.pmod(F.col(row_id), F.lit(every)) == 0
    return rows.where(~is_test), rows.where(is_test)


def write_snapshot(spark: SparkSession, done: Training, path: str,
                   mode: str = "overwrite") -> None:
    """Parameters and optimizer moments as rows of equal slices, written by the cluster."""
    done.snapshot(spark).write.mode(mode).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The slices to go on from; tasks read them, the driver doesn't."""
    return spark.read.schema(SNAPSHOT).parquet(path)


def states_of(snapshot: DataFrame) -> dict[int, State]:
    """The states on the driver, to look at or to score with: for small networks."""
    pieces: dict[int, list] = {}
    for row in snapshot.collect():
        pieces.setdefault(row["combo_id"], []).append(row)
    states = {}
    for combo_id, rows in pieces.items():
        rows.sort(key=lambda r: r["slice"])
        theta, first, second = (np.concatenate([r[c] for r in rows])
                                for c in ("theta", "first", "second"))
        states[combo_id] = State(list(rows[0]["sizes"]), theta, first, second,
                                 rows[0]["step"], rows[0]["epoch"])
    return states
