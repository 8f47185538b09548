"""Logistic regression by batch gradient descent."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.functions.vectors import dot, literal_vector, logistic_scale
from svmflow.sources.points import DIMS


def gradient_columns(weights: Sequence[Column], y: Column, x: Sequence[Column]) -> tuple[Column, list[Column]]:
    """The row factor of the gradient, and its product with each x given as column ``_scale``."""
    scale = logistic_scale(y, dot(weights, x))
    return scale, [F.col("_scale") * xi for xi in x]


def point_gradients(points: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Gradient of each point, as columns ``g0 ..`` next to the point's own columns."""
    x = [F.col("x")[i] for i in range(len(weights))]
    scale, parts = gradient_columns(literal_vector(weights), F.col("y"), x)
    named = [g.alias(f"g{i}") for i, g in enumerate(parts)]
    return points.withColumn("_scale", scale).select(*points.columns, *named)


def fit_logreg(
    points: DataFrame,
    iterations: int,
    *,
    initial: Sequence[float] | None = None,
    seed: int = 42,
    dims: int = DIMS,
) -> list[float]:
    """Weights after ``iterations`` full-batch steps of size 1.

    Starts from ``initial``, or from seeded uniform values in (-1, 1).

    One aggregation job per step over the cached points; only the ``dims``
    sums reach the driver, and the weights go back as a table of one row, so
    that all steps run the same generated code.
    """
    if initial is None:
        draw = random.Random(seed)
        initial = [draw.uniform(-1.0, 1.0) for _ in range(dims)]
    weights = [float(w) for w in initial]
    if len(weights) != dims:
        raise ValueError(f"{dims} initial weights needed, got {len(weights)}")
    flat = points.select("y", *(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    flat = flat.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        x = [F.col(f"x{i}") for i in range(dims)]
        names = [f"w{i}" for i in range(dims)]
        scale, parts = gradient_columns([F.col(w) for w in names], F.col("y"), x)
        sums = [F.sum(g).alias(f"g{i}") for i, g in enumerate(parts)]
        for _ in range(iterations):
            current = points.sparkSession.createDataFrame([tuple(weights)], ", ".join(f"{w} double" for w in names))
            step = flat.crossJoin(F.broadcast(current)).withColumn("_scale", scale).agg(*sums).first()  # one row
            weights = [w - (g or 0.0) for w, g in zip(weights, step, strict=True)]
    finally:
        flat.unpersist()
    return weights


def weights_frame(points: DataFrame, weights: Sequence[float]) -> DataFrame:
    """The weight vector as rows (i, w)."""
    return points.sparkSession.createDataFrame(list(enumerate(map(float, weights))), "i int, w double")
