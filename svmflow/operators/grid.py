"""Expansion of (C, gamma) parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_SCHEMA = "c_step double, g_step double, c_init double, g_init double, c_max double, g_max double"


def _axis(init: str, step: str, limit: str) -> Column:
    """Values init + step*i up to and including the limit.

    The sequence runs one past the rounded quotient and the comparison decides,
    so rounding in the quotient cannot lose or add a value.
    """
    s = F.col(step)
    good = F.when(s > 0, s).otherwise(F.raise_error(F.lit(f"{step} must be positive")).cast("double"))
    last = F.floor((F.col(limit) - F.col(init)) / good) + 1
    values = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.col(init) + s * i)
    return F.when(F.col(limit) >= F.col(init), F.filter(values, lambda v: v <= F.col(limit)))


def expand_grid(specs: DataFrame) -> DataFrame:
    """All (c, g) pairs of every grid given by a row of ``specs``; other columns are kept."""
    spec_cols = [field.split()[0] for field in GRID_SCHEMA.split(", ")]
    kept = [name for name in specs.columns if name not in spec_cols]
    return (
        specs.withColumn("c", F.explode(_axis("c_init", "c_step", "c_max")))
        .withColumn("g", F.explode(_axis("g_init", "g_step", "g_max")))
        .select(*kept, "c", "g")
    )


def param_grid(
    spark: SparkSession, c_step: float, g_step: float, c_init: float, g_init: float, c_max: float, g_max: float
) -> DataFrame:
    """One grid from plain numbers."""
    row = tuple(float(v) for v in (c_step, g_step, c_init, g_init, c_max, g_max))
    return expand_grid(spark.createDataFrame([row], GRID_SCHEMA))
