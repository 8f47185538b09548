"""Cascade SVM training: split, train, keep support vectors, merge pairs, repeat."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from svmflow.functions.vectors import last_index
from svmflow.operators.large_group import train_large_groups
from svmflow.operators.metrics import accuracy
from svmflow.operators.scoring import Scorer
from svmflow.operators.split import count_buckets, merge_pairs, stratified_split
from svmflow.operators.subset_train import (
    DEFAULT_EPS,
    Cell,
    feature_dim,
    per_cell,
    train_subsets,
    trained_schema,
    with_cell,
)
from svmflow.session import Scratch, materialise, scratch_path

ROWS_PER_SUBSET = 2500
# Rows of a group that one task solves at once. Its kernel cache has a fixed size, so this bounds time, not memory;
# larger groups are solved in working sets of as many, and kept in chunks half as large.
BLOCK_ROWS = 4000


@dataclass(frozen=True)
class CascadeResult:
    """Trained models, their support vectors, and the folder with every layer's survivors."""

    models: DataFrame
    support_vectors: DataFrame
    layers_path: str

    def layers(self) -> DataFrame:
        """Rows that survived each layer, with ``layer`` and ``subset_id``."""
        return self.models.sparkSession.read.parquet(self.layers_path)


def _train_layer(
    groups: DataFrame, cells: Sequence[Cell], path: str, *, n_subsets: int, eps: float, block_rows: int, group_bound: int
) -> tuple[DataFrame, int]:
    """Train every group of a layer into a table: in a task each where all fit one, else all together by decomposition.

    ``group_bound`` is a known upper bound of the group sizes; only where it
    is over a block the largest group is counted. Returns the table and the bound known by then.
    """
    schema = trained_schema(groups)
    if "model_id" not in groups.columns and group_bound > block_rows:
        groups = per_cell(groups, cells)
    if group_bound > block_rows:
        sizes = groups.groupBy("model_id", "subset_id").count()
        group_bound = sizes.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if group_bound <= block_rows:
        return materialise(train_subsets(groups, cells, n_subsets=n_subsets, eps=eps), path), group_bound
    tuned = with_cell(groups, cells, "c", "gamma")
    if not all(c.gamma for c in cells):
        tuned = tuned.join(feature_dim(groups, ["model_id", "subset_id"]), ["model_id", "subset_id"])
        tuned = tuned.withColumn("gamma", F.coalesce("gamma", 1.0 / F.greatest(F.lit(1), "max_index")))
    # Every round passes over the group, so a working set is as large as a task may solve: rounds are as few as can be.
    trained = train_large_groups(
        tuned, schema, path, largest=group_bound, eps=eps, working_rows=block_rows, chunk_rows=max(2, block_rows // 2)
    )
    return trained, group_bound


def cascade_train(
    samples: DataFrame,
    cells: Sequence[Cell] = (Cell("cascade"),),
    *,
    n_subsets: int | None = None,
    rows_per_subset: int = ROWS_PER_SUBSET,
    block_rows: int = BLOCK_ROWS,
    gamma_scope: str = "global",
    eps: float = DEFAULT_EPS,
    seed: int = 0,
) -> CascadeResult:
    """Train one binary RBF model per cell on ``samples`` (row_id, label +1/-1, features).

    All cells share the split and, in the first layer, the pass over the data,
    a few cells at a time also its distances; after that only support vectors
    move, and a merged group starts from the alphas of its halves. Each
    layer is written to the shared folder, so a lost executor costs one
    layer's tasks at most and no layer is trained twice. ``n_subsets`` may be
    any number from 1; by default it follows the row count. With
    ``gamma_scope='subset'`` an unset gamma is 1/largest index of each subset,
    otherwise of all samples.
    """
    spark = samples.sparkSession
    rows = samples.select("row_id", "label", "features").where(F.col("label").isin(1.0, -1.0))
    if gamma_scope not in ("global", "subset"):
        raise ValueError("gamma_scope must be 'global' or 'subset'")
    with Scratch(spark, "cascade-run") as scratch:
        # One pass gives the class sizes, the largest index and the split's bucket table.
        top = F.max(last_index(F.col("features"))).alias("_top")
        buckets = count_buckets(rows, top, write=scratch.write, label="label", seed=seed)
        stats = buckets.sizes.agg(
            F.sum(F.when(F.col("label") > 0, F.col("_n"))).alias("pos"),
            F.sum(F.when(F.col("label") < 0, F.col("_n"))).alias("neg"),
            F.max("_top").alias("top"),
        ).first()
        if not stats["pos"] or not stats["neg"]:
            raise ValueError("training needs rows of both classes +1 and -1")
        if gamma_scope == "global":
            cells = [c if c.gamma else replace(c, gamma=1.0 / max(1, stats["top"] or 0)) for c in cells]

        n = n_subsets or math.ceil((stats["pos"] + stats["neg"]) / rows_per_subset)
        layers_path = scratch_path(spark, "cascade")
        groups = stratified_split(rows, n, label="label", seed=seed, buckets=buckets)
        # The split fixes the size of the first layer's groups; a merge at most doubles it.
        bound = math.ceil(stats["pos"] / n) + math.ceil(stats["neg"] / n)
        if bound > block_rows:
            groups = scratch.write(groups)
        layer = 1
        while True:
            path = f"{layers_path}/layer={layer}"
            trained, bound = _train_layer(
                groups, cells, path, n_subsets=n, eps=eps, block_rows=block_rows, group_bound=bound
            )
            if n == 1:
                break
            groups = merge_pairs(trained).drop("rho")
            n, layer, bound = (n + 1) // 2, layer + 1, 2 * bound

        last = groups if "model_id" in groups.columns else per_cell(groups.select("features"), cells)
        models = _model_table(trained, cells)
        if not all(c.gamma for c in cells):
            tops = feature_dim(last, ["model_id"])
            models = models.join(tops, "model_id").withColumn(
                "gamma", F.coalesce("gamma", 1.0 / F.greatest(F.lit(1), "max_index"))
            ).drop("max_index")
            models = materialise(models, scratch_path(spark, "cascade-models"))
        return CascadeResult(models, _support_table(trained), layers_path)


def _model_table(trained: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    no_doubles = F.lit(None).cast("array<double>")
    found = trained.groupBy("model_id").agg(
        F.first("rho").alias("_rho"),
        F.count("*").alias("total_sv"),
        F.count_if(F.col("label") > 0).alias("_pos"),
        F.count_if(F.col("label") < 0).alias("_neg"),
    )
    return with_cell(found, cells, "c", "gamma").select(
        "model_id",
        F.lit("c_svc").alias("svm_type"),
        F.lit("rbf").alias("kernel_type"),
        F.lit(3).alias("degree"),
        "gamma",
        F.lit(0.0).alias("coef0"),
        "c",
        F.lit(2).alias("nr_class"),
        "total_sv",
        F.array("_rho").alias("rho"),
        F.array(F.lit(1), F.lit(-1)).alias("label"),
        no_doubles.alias("prob_a"),
        no_doubles.alias("prob_b"),
        F.array("_pos", "_neg").alias("n_sv"),
    )


def _support_table(trained: DataFrame) -> DataFrame:
    row_id = trained.schema["row_id"].dataType
    sv_id = F.col("row_id").cast("bigint") if isinstance(row_id, T.IntegralType) else F.xxhash64("row_id")
    return trained.select(
        "model_id",
        sv_id.alias("sv_id"),
        "row_id",
        "label",
        F.array(F.col("label") * F.col("alpha")).alias("coef"),
        "features",
    )


def support_vector_rows(samples: DataFrame, result: CascadeResult, model_id: str) -> DataFrame:
    """The training rows, all their columns, that are support vectors of a model."""
    kept = result.support_vectors.where(F.col("model_id") == model_id).select("row_id")
    return samples.join(kept, "row_id", "left_semi")


def cascade_predict(result: CascadeResult, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and accuracy per model of freshly trained models on ``test``.

    Scoring takes the rows times the support vectors, so the predictions are written once, for all that is asked of them.
    """
    predictions = materialise(_predictions(result, test), scratch_path(test.sparkSession, "predictions"))
    return predictions, accuracy(predictions, by=["model_id"])


def _predictions(result: CascadeResult, test: DataFrame) -> DataFrame:
    return Scorer(result.models, result.support_vectors).score(test.withColumnRenamed("label", "target"))


def grid_search(train: DataFrame, test: DataFrame, grid: DataFrame, **options) -> DataFrame:
    """Accuracy (c, g, acc) of a cascade model per grid point, best first.

    The grid is a parameter list and is read to the driver; the data is split
    once, trained for all points together and scored in a single pass.
    """
    cells = _grid_cells(grid)
    acc = accuracy(_predictions(cascade_train(train, cells, **options), test), by=["model_id"])
    return _by_point(acc, cells).orderBy(F.desc("acc"), "c", "g")


def cross_validate(samples: DataFrame, grid: DataFrame, *, folds: int = 3, seed: int = 0, **options) -> DataFrame:
    """(c, g, total, correct, acc, best) per grid point, over rows that its models were not trained on.

    Every row is held out once, in the fold that a seeded hash of its id
    names. A fold is trained for all points together, and its rows are scored in a single
    pass. ``best`` marks the point of the highest accuracy, of equals the smallest C and gamma.
    """
    cells = _grid_cells(grid)
    fold = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(folds))
    parts = []
    for i in range(folds):
        trained = cascade_train(samples.where(fold != i), cells, **options)
        acc = accuracy(_predictions(trained, samples.where(fold == i)), by=["model_id"])
        parts.append(acc.select("model_id", "total", "correct"))
    sums = reduce(DataFrame.unionByName, parts).groupBy("model_id").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    found = _by_point(sums.withColumn("accuracy", F.try_divide("correct", "total") * 100.0), cells, "total", "correct")
    found = materialise(found, scratch_path(samples.sparkSession, "validated"))
    best = found.agg(F.max(F.struct("acc", -F.col("c"), -F.col("g"))).alias("best"))
    marked = F.struct("acc", -F.col("c"), -F.col("g")) == F.col("best")
    return found.crossJoin(best).withColumn("best", marked)  # one row


def _grid_cells(grid: DataFrame) -> list[Cell]:
    points = grid.select("c", "g").orderBy("c", "g").collect()
    return [Cell(f"grid-{i}", row["c"], row["g"]) for i, row in enumerate(points)]


def _by_point(acc: DataFrame, cells: Sequence[Cell], *more: str) -> DataFrame:
    return with_cell(acc, cells, "c", "gamma").select("c", F.col("gamma").alias("g"), *more, F.col("accuracy").alias("acc"))
