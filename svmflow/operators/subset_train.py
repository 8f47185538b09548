"""C-SVC training of many bounded subsets at once, one group per subset."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from svmflow.functions.parsing import FEATURES_TYPE
from svmflow.functions.solver import CACHE_BYTES, RbfKernel, offset, solve
from svmflow.functions.sparse import FEATURES_ARROW, from_arrow, square_distances
from svmflow.functions.vectors import last_index
from svmflow.operators.split import TASK, place_groups

# The training parameters of the reference jobs.
DEFAULT_C = 1.0
DEFAULT_EPS = 1e-3
# Cells that share a task and its distances while no cell has gone its own way; more cells take several passes over a subset.
CELLS_PER_TASK = 4
_BUNDLE = "_bundle"


@dataclass(frozen=True)
class Cell:
    """One (C, gamma) setting and the model it leads to; gamma None or 0 means 1/largest index."""

    model_id: str
    c: float = DEFAULT_C
    gamma: float | None = None


def cell_table(spark: SparkSession, cells: Sequence[Cell]) -> DataFrame:
    """The cells as (model_id, cell_no, bundle, c, gamma), for joins: a plan does not grow with the grid."""
    rows = [(cell.model_id, i, i // CELLS_PER_TASK, float(cell.c), cell.gamma or None) for i, cell in enumerate(cells)]
    return spark.createDataFrame(rows, f"model_id string, cell_no int, {_BUNDLE} int, c double, gamma double")


def with_cell(df: DataFrame, cells: Sequence[Cell], *columns: str) -> DataFrame:
    """``df`` with columns of the cell that its model_id names."""
    # A parameter list, sent from the driver in any case.
    return df.join(F.broadcast(cell_table(df.sparkSession, cells).select("model_id", *columns)), "model_id")


def per_cell(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """Every row once for each cell, with its model_id."""
    bundles = -(-len(cells) // CELLS_PER_TASK)
    dealt = df.withColumn(_BUNDLE, F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    return dealt.join(F.broadcast(cell_table(df.sparkSession, cells).select("model_id", _BUNDLE)), _BUNDLE).drop(_BUNDLE)


def feature_dim(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest feature index, in all or per group; 0 without any feature."""
    return samples.groupBy(*by).agg(F.coalesce(F.max(last_index(F.col("features"))), F.lit(0)).alias("max_index"))


def default_gamma(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1/largest feature index, or 0 where there is none."""
    return feature_dim(samples, by).withColumn(
        "gamma", F.when(F.col("max_index") > 0, F.lit(1.0) / F.col("max_index")).otherwise(F.lit(0.0))
    )


def precomputed_check(samples: DataFrame, max_index: int) -> DataFrame:
    """Rows that cannot be used with a precomputed kernel, with the reason.

    The first feature must have index 0 and a serial number in 1..max_index.
    """
    first = F.get("features", F.lit(0))
    serial = first["val"].try_cast("int")
    reason = F.when(
        first.isNull() | (first["idx"] != 0), "first column must be 0:sample_serial_number"
    ).when((serial <= 0) | (serial > max_index) | serial.isNull(), "sample_serial_number out of range")
    return samples.withColumn("reason", reason).where(F.col("reason").isNotNull())


def trained_schema(samples: DataFrame) -> T.StructType:
    row_id = samples.schema["row_id"].dataType
    return T.StructType(
        [
            T.StructField("model_id", T.StringType()),
            T.StructField("subset_id", T.IntegerType()),
            T.StructField("row_id", row_id),
            T.StructField("label", T.DoubleType()),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("rho", T.DoubleType()),
            T.StructField("features", T._parse_datatype_string(FEATURES_TYPE)),
        ]
    )


def _trainer(cells: Sequence[Cell], eps: float, keep_all: bool) -> Callable[[pa.Table], pa.Table]:
    """Group function: all cells that apply to a subset, sharing its distances where these fit the kernel cache."""
    by_id = {cell.model_id: cell for cell in cells}

    def run(group: pa.Table) -> pa.Table:
        # Row order decides ties in the solver, so it must not depend on the shuffle.
        group = group.sort_by("row_id")
        y = np.sign(group["label"].to_numpy())
        rows = from_arrow(group["features"])
        if "model_id" in group.schema.names:
            todo = [by_id[group["model_id"][0].as_py()]]
        else:
            first = group[_BUNDLE][0].as_py() * CELLS_PER_TASK
            todo = cells[first : first + CELLS_PER_TASK]
        started = group["alpha"].to_numpy() if "alpha" in group.schema.names else np.zeros(len(y))
        one_class = len(np.unique(y)) < 2
        shared = len(todo) > 1 and not one_class and 8 * len(y) ** 2 <= CACHE_BYTES
        distances = square_distances(rows, rows) if shared else None
        # Indices ascend, so the last of a row is its largest.
        ends = rows.offsets[1:][np.diff(rows.offsets) > 0] - 1
        top = float(max(rows.idx[ends].max(initial=0), 1))
        out = []
        for cell in todo:
            if one_class:
                # Nothing to separate: the rows move on unchanged and meet the other class later.
                alpha, rho, keep = np.zeros(len(y)), float("nan"), np.ones(len(y), dtype=bool)
            else:
                kernel = RbfKernel(rows, cell.gamma or 1.0 / top, distances=distances)
                pulling = np.flatnonzero(started > 0)
                gradient = -np.ones(len(y))
                if len(pulling):
                    gradient += y * kernel.pulls(np.arange(len(y)), pulling, (y * started)[pulling])
                alpha, gradient = solve(kernel, y, cell.c, eps, started, gradient)
                rho = offset(alpha, y, gradient, cell.c)
                del kernel  # before the next cell makes its own
                if not np.isfinite(alpha).all() or not np.isfinite(rho):
                    raise ValueError(f"model {cell.model_id}: training rows hold values that are not finite")
                keep = np.ones(len(y), dtype=bool) if keep_all else alpha > 0
            kept = group.filter(pa.array(keep))
            n = kept.num_rows
            out.append(
                pa.table(
                    {
                        "model_id": pa.array([cell.model_id] * n, pa.string()),
                        "subset_id": kept["subset_id"],
                        "row_id": kept["row_id"],
                        "label": kept["label"],
                        "alpha": pa.array(alpha[keep]),
                        "rho": pa.array(np.full(n, rho)),
                        "features": kept["features"].cast(FEATURES_ARROW),
                    }
                )
            )
        return pa.concat_tables(out)

    return run


def train_subsets(
    subsets: DataFrame,
    cells: Sequence[Cell],
    *,
    n_subsets: int,
    eps: float = DEFAULT_EPS,
    keep_all: bool = False,
) -> DataFrame:
    """Train every subset and return its support vectors with alpha and rho.

    ``subsets`` has row_id, subset_id, label and features, and model_id once
    cells have gone separate ways; without model_id a task trains a subset for
    up to ``CELLS_PER_TASK`` cells. With an alpha column training starts from it: the labelled sum
    of a subset's alphas must be zero, as it is for merged subsets. Groups must be bounded: see ``cascade`` for the
    check and for the way larger groups take. ``keep_all`` also returns rows
    with alpha 0.
    """
    cells = list(cells)
    if "model_id" in subsets.columns:
        keys, n_groups = ["model_id", "subset_id"], n_subsets * len(cells)
        subsets = with_cell(subsets, cells, "cell_no")
        group_no = F.col("cell_no") * n_subsets + F.col("subset_id")
    else:
        n_bundles = -(-len(cells) // CELLS_PER_TASK)
        subsets = subsets.withColumn(_BUNDLE, F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))))
        keys, n_groups = [_BUNDLE, "subset_id"], n_subsets * n_bundles
        group_no = F.col(_BUNDLE) * n_subsets + F.col("subset_id")
    more = [c for c in ("alpha", "cell_no") if c in subsets.columns]
    placed = place_groups(subsets.select(*keys, "row_id", "label", "features", *more), n_groups, group_no)
    return placed.groupBy(TASK, *keys).applyInArrow(_trainer(cells, eps, keep_all), trained_schema(subsets))
