"""Evaluation of predictions: one distributed aggregate each.

Empty input and zero variance give null, where plain division would give NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(
    predictions: DataFrame, *, prediction: str = "prediction", target: str = "target", by: Sequence[str] = ()
) -> DataFrame:
    """Rows, exact hits and accuracy in percent, in all or per ``by`` group."""
    counts = predictions.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(prediction) == F.col(target)).alias("correct"),
    )
    return counts.withColumn("accuracy", F.try_divide("correct", "total") * 100.0)


def regression_error(
    predictions: DataFrame, *, prediction: str = "prediction", target: str = "target", by: Sequence[str] = ()
) -> DataFrame:
    """Mean squared error and squared correlation coefficient.

    The correlation comes from centred moments, which tasks compute and merge,
    so values far from zero do not cancel. Rows without a value count in the
    total only.
    """
    v, y = F.col(prediction), F.col(target)
    both = v.isNotNull() & y.isNotNull()
    moments = predictions.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum((v - y) * (v - y)).alias("_se"),
        F.covar_pop(v, y).alias("_vy"),
        F.var_pop(F.when(both, v)).alias("_vv"),
        F.var_pop(F.when(both, y)).alias("_yy"),
    )
    return moments.select(
        *by,
        "total",
        F.try_divide("_se", "total").alias("mse"),
        F.try_divide(F.col("_vy") * F.col("_vy"), F.col("_vv") * F.col("_yy")).alias("squared_correlation"),
    )
