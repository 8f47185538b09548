"""Streams of arriving text files: landing them, and scoring them as they come."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from svmflow.functions.parsing import FEATURES_TYPE, REJECT_REASON, accepted
from svmflow.operators.metrics import accuracy
from svmflow.operators.scoring import Scorer
from svmflow.sources.model_store import load_model
from svmflow.sources.samples import parse_samples
from svmflow.sources.text import SOURCE_FILE


def stream_lines(spark: SparkSession, source: str, *, max_files: int | None = None) -> DataFrame:
    """Lines of files as they arrive under ``source``, with the file each came from."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(source).select("value", F.col("_metadata.file_path").alias(SOURCE_FILE))


def _start(df: DataFrame, table_path: str, checkpoint: str, once: bool) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_stream(
    spark: SparkSession,
    source: str,
    table_path: str,
    checkpoint: str,
    *,
    once: bool = True,
    max_files: int | None = None,
) -> StreamingQuery:
    """Append lines of new files to a table, each file exactly once, also after a restart.

    ``once`` takes what is there and stops; otherwise the query keeps running.
    """
    return _start(stream_lines(spark, source, max_files=max_files), table_path, checkpoint, once)


def score_stream(
    spark: SparkSession,
    source: str,
    scorer: Scorer,
    table_path: str,
    checkpoint: str,
    *,
    run_ts: str,
    once: bool = True,
    max_files: int | None = None,
) -> StreamingQuery:
    """Score sample files as they arrive into a predictions table.

    Stateless and narrow: parsing and scoring per row, no shuffle. Malformed
    lines stay in the table with their ``reject_reason`` and a null prediction.
    """
    lines = stream_lines(spark, source, max_files=max_files)
    fine = F.col(REJECT_REASON).isNull()
    samples = parse_samples(lines).select(
        SOURCE_FILE,
        "value",
        F.when(fine, F.col("label")).alias("target"),
        F.when(fine, F.col("features")).otherwise(F.array().cast(FEATURES_TYPE)).alias("features"),
        REJECT_REASON,
        F.lit(run_ts).alias("run_ts"),
    )
    scored = scorer.score(samples)
    made = [c for c in scored.columns if c not in samples.columns and c != "model_id"]
    scored = scored.withColumns({c: F.when(fine, F.col(c)) for c in made})
    return _start(scored, table_path, checkpoint, once)


def score_arrivals(
    spark: SparkSession,
    source: str,
    store: str,
    model_id: str,
    table_path: str,
    checkpoint: str,
    *,
    probability: bool = False,
) -> str:
    """Score the files that have arrived since the last call, in one micro-batch, with the newest run of a model.

    The run is looked up when the micro-batch starts, and its rows carry it.
    Calls share the checkpoint, so each file is scored once; a batch that
    failed is scored anew by the next call, with the run that is newest then. Returns the run.
    """
    models, vectors = load_model(spark, store, model_id)
    run_ts = models.first()["run_ts"]
    with Scorer(models.drop("run_ts"), vectors.drop("run_ts"), probability=probability) as scorer:
        score_stream(spark, source, scorer, table_path, checkpoint, run_ts=run_ts).awaitTermination()
    return run_ts


def follow_arrivals(
    spark: SparkSession,
    source: str,
    store: str,
    model_id: str,
    table_path: str,
    checkpoint: str,
    *,
    stopped: Callable[[], bool],
    every: float = 10.0,
    **options,
) -> None:
    """Keep scoring arriving files until ``stopped()``, every micro-batch with the run that is newest by then."""
    while True:
        started = time.monotonic()
        score_arrivals(spark, source, store, model_id, table_path, checkpoint, **options)
        if stopped():
            return
        time.sleep(max(0.0, every - (time.monotonic() - started)))


def file_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy per arrived file, model and run, over the lines that could be read."""
    return accuracy(accepted(predictions), by=[SOURCE_FILE, "model_id", "run_ts"])
