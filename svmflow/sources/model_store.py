"""Models as two tables: ``models`` (scalars) and ``support_vectors``."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.functions.parsing import FEATURES_TYPE
from svmflow.sources.samples import feature_text

MODEL_SCHEMA = (
    "model_id string, svm_type string, kernel_type string, degree int, gamma double, coef0 double, c double, "
    "nr_class int, total_sv bigint, rho array<double>, label array<int>, prob_a array<double>, "
    "prob_b array<double>, n_sv array<bigint>"
)
SUPPORT_SCHEMA = f"model_id string, sv_id bigint, label double, coef array<double>, features {FEATURES_TYPE}"

# Fixed value: run stamps read yyyyMMddHHmmss.
_RUN_STAMP = "%Y%m%d%H%M%S"


def run_stamp() -> str:
    return datetime.now(UTC).strftime(_RUN_STAMP)


def model_row(
    spark: SparkSession,
    model_id: str,
    *,
    svm_type: str = "c_svc",
    kernel_type: str = "rbf",
    degree: int = 3,
    gamma: float = 0.0,
    coef0: float = 0.0,
    c: float | None = None,
    total_sv: int | None = None,
    rho: list[float],
    label: list[int] | None = None,
    prob_a: list[float] | None = None,
    prob_b: list[float] | None = None,
    n_sv: list[int] | None = None,
) -> DataFrame:
    """One row of the ``models`` table."""
    nr_class = len(label) if label else 2
    row = (
        model_id, svm_type, kernel_type, degree, gamma, coef0, c, nr_class, total_sv, rho, label, prob_a, prob_b, n_sv,
    )
    return spark.createDataFrame([row], MODEL_SCHEMA)


def save_model(models: DataFrame, support_vectors: DataFrame, path: str, *, run_ts: str | None = None) -> str:
    """Write models under (model_id, run_ts); saving the same key again replaces it.

    Nothing else in the tables is touched, so runs and models live side by side.
    """
    run_ts = run_ts or run_stamp()
    for name, df in (("support_vectors", support_vectors), ("models", models)):
        (
            df.withColumn("run_ts", F.lit(run_ts))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("model_id", "run_ts")
            .parquet(f"{path}/{name}")
        )
    return run_ts


def load_model(
    spark: SparkSession, path: str, model_id: str, *, run_ts: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The ``models`` and ``support_vectors`` rows of one model; its latest run unless one is named.

    Only that model's partitions are read. A missing model raises ``LookupError``.
    """
    partitioned = "model_id string, run_ts string"
    models = spark.read.schema(f"{MODEL_SCHEMA.removeprefix('model_id string, ')}, {partitioned}").parquet(
        f"{path}/models"
    )
    mine = models.where(F.col("model_id") == model_id)
    if run_ts is None:
        run_ts = mine.agg(F.max("run_ts")).first()[0]
    chosen = mine.where(F.col("run_ts") == F.lit(run_ts))
    if run_ts is None or chosen.isEmpty():
        raise LookupError(f"no model {model_id!r} at {path}")
    vectors = spark.read.schema(f"{SUPPORT_SCHEMA.removeprefix('model_id string, ')}, {partitioned}").parquet(
        f"{path}/support_vectors"
    )
    return chosen, vectors.where((F.col("model_id") == model_id) & (F.col("run_ts") == F.lit(run_ts)))


def support_vector_text(label: str = "label") -> Column:
    """A support vector as a training line: signed class, then ``idx:val`` each followed by a blank.

    The class is the row's true label, not a guess from its coefficient.
    """
    sign = F.when(F.col(label) > 0, "+1 ").otherwise("-1 ")
    pairs = feature_text()
    return F.concat(sign, pairs, F.when(F.size("features") > 0, " ").otherwise(""))


def export_support_vectors(support_vectors: DataFrame, models: DataFrame, *, run_ts: str | None = None) -> DataFrame:
    """Support vectors as training lines, with the C and gamma they were found with and the run stamp."""
    # One small row per model, sent to where the vectors are: a shuffle would put a whole model into one task.
    scalars = F.broadcast(models.select("model_id", F.col("c").cast("double"), F.col("gamma").cast("double").alias("g")))
    return support_vectors.join(scalars, "model_id").select(
        "model_id", "sv_id", support_vector_text().alias("line"), "c", "g", F.lit(run_ts or run_stamp()).alias("run_ts")
    )
