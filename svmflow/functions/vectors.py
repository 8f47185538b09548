"""Column expressions over feature vectors; all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    """Dot product of two vectors of columns, summed left to right from 0."""
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def literal_vector(values: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def logistic_scale(y: Column, margin: Column) -> Column:
    """Per-row factor of the logistic-loss gradient: (1/(1+exp(-y*m)) - 1)*y."""
    return (1.0 / (1.0 + F.exp(-y * margin)) - 1.0) * y


def vector_sum(array_col: str) -> Column:
    """Aggregate: element-wise sum of an array column; one partial vector per task and group."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(array_col).cast("array<double>"))))


def last_index(features: Column) -> Column:
    """Index of a row's last stored feature; null for a row without features."""
    return F.try_element_at(features, F.lit(-1)).getField("idx")
