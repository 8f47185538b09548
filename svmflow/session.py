"""Session settings and the shared folder that intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder reachable from every executor, as named by the session.

    Only a local session without a setting gets a temporary folder; on a
    cluster a missing setting is an error, because an executor's own disk
    disappears with the executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get(CHECKPOINT_CONF, None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
            configured = tempfile.mkdtemp(prefix="svmflow-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and continue from the table.

    Cuts the lineage like a checkpoint, but the table is columnar, so later
    steps read only the columns they use, and of the values of ``by`` only those they ask for.
    """
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run, removed as later ones replace them, and all at the end or on failure.

    What outlives the run is written elsewhere.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.name = name
        self._paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        while self._paths:
            discard(self.spark, self._paths.pop())

    def path(self, name: str) -> str:
        """A fresh path that goes with the run."""
        found = scratch_path(self.spark, f"{self.name}-{name}")
        self._paths.append(found)
        return found

    def write(self, df: DataFrame, keep: int | None = None, by: Sequence[str] = ()) -> DataFrame:
        """``df`` as a table of the run; with ``keep`` only so many tables written before it stay."""
        table = materialise(df, self.path("table"), by)
        if keep is not None:
            written = [p for p in self._paths if "-table-" in p]
            for old in written[: -1 - keep]:
                self._paths.remove(old)
                discard(self.spark, old)
        return table


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that a newer one has replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
