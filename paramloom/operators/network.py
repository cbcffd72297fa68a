"""Layers applied to a table of vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from paramloom.functions.vectors import cross_entropy, is_correct

Layer = tuple[np.ndarray, np.ndarray]  # weights (inputs, outputs), bias (outputs)


def forward(layers: list[Layer], rows: np.ndarray) -> np.ndarray:
    """Linear layers with ReLU between them."""
    for position, (weights, bias) in enumerate(layers):
        rows = rows @ weights + bias
        if position < len(layers) - 1:
            rows = np.maximum(rows, 0.0)
    return rows


def usable_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the vectors of the right length, and those as a matrix."""
    good = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    flat = vectors.filter(good).flatten().to_numpy(zero_copy_only=False)
    return good.to_numpy(zero_copy_only=False), flat.astype(np.float64).reshape(-1, width)


def score(df: DataFrame, vector: str, layers: list[Layer], name: str = "logits",
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``name ARRAY<DOUBLE>``: the network's output per row.

    A missing vector, or one of another length, gives NULL.
    """
    keep = [c for c in df.columns if c != vector] if keep is None else keep
    width, outputs = layers[0][0].shape[0], layers[-1][0].shape[1]
    schema = StructType([df.schema[c] for c in keep]
                        + [StructField(name, ArrayType(DoubleType()))])

    def apply(batches):
        for batch in batches:
            good, rows = usable_rows(batch.column(0), width)
            values = forward(layers, rows).ravel()
            offsets = np.concatenate([[0], np.cumsum(good * outputs)]).astype(np.int32)
            scored = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(values), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], scored], names=[*keep, name])

    return df.select(vector, *keep).mapInArrow(apply, schema)


def unit_rows(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Long form ``(row id, unit, value)`` of a vector column."""
    return df.select(row_id, F.posexplode(column).alias("unit", "value"))


def with_loss(scored: DataFrame, label: Column, logits: str = "logits") -> DataFrame:
    """Adds ``loss`` (softmax cross-entropy) and ``correct`` (0 or 1)."""
    return scored.withColumn("loss", cross_entropy(F.col(logits), label)) \
        .withColumn("correct", is_correct(F.col(logits), label))
