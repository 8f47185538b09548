"""Predictions and their metrics as tables, one partition per model and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.operators.metrics import accuracy, regression_error
from svmflow.operators.scoring import REGRESSORS, Model
from svmflow.sources.model_store import run_stamp

_KEYS = ["model_id", "run_ts"]


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_KEYS).parquet(path)


def save_predictions(
    predictions: DataFrame, path: str, models: Model | Sequence[Model], *, run_ts: str | None = None
) -> str:
    """Write the predictions of all ``models`` at once, and the metrics that go with each model's kind.

    ``<path>/predictions`` holds one row per input and model;
    ``<path>/metrics`` one row per model and run: accuracy for classifiers,
    squared error and correlation for regression. Saving a model's run again
    replaces it and leaves other models and runs alone. The metrics are
    computed from the stored rows, so nothing is scored twice.
    """
    run_ts = run_ts or run_stamp()
    models = [models] if isinstance(models, Model) else list(models)
    ids = [m.model_id for m in models]
    mine = predictions.where(F.col("model_id").isin(ids)).withColumn("run_ts", F.lit(run_ts))
    _write(mine, f"{path}/predictions")
    stored = predictions.sparkSession.read.schema(mine.schema).parquet(f"{path}/predictions")
    for kind, measure in (("regression", regression_error), ("classification", accuracy)):
        of_kind = [m.model_id for m in models if (m.svm_type in REGRESSORS) == (kind == "regression")]
        if of_kind:
            rows = stored.where((F.col("run_ts") == run_ts) & F.col("model_id").isin(of_kind))
            _write(measure(rows, by=_KEYS), f"{path}/metrics/kind={kind}")
    return run_ts
