"""Expressions on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def relu(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0.0)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Softmax cross-entropy of the 0-based ``label``, shifted by the maximum."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return F.log(total) + top - F.get(logits, label)


def predicted(logits: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(logits, F.array_max(logits)) - 1


def is_correct(logits: Column, label: Column) -> Column:
    return F.when(predicted(logits) == label, F.lit(1)).otherwise(F.lit(0))
