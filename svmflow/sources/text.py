"""Line-oriented text sources and the landing table."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.session import materialise, scratch_path

SOURCE_FILE = "source_file"


def read_lines(spark: SparkSession, path: str, *, with_file: bool = False) -> DataFrame:
    """One row per line (``value``); directories are read recursively."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    return df.select("value", F.col("_metadata.file_path").alias(SOURCE_FILE)) if with_file else df


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and its whole text."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias(SOURCE_FILE), "value")


MANIFEST_SCHEMA = f"{SOURCE_FILE} string, path string, size bigint, modified timestamp, status string, landing int"

# What a landing finds about a file, against the landing before.
NEW, CHANGED, EMPTIED, REMOVED, UNCHANGED = "new", "changed", "emptied", "removed", "unchanged"


def list_files(spark: SparkSession, source: str) -> DataFrame:
    """(source_file, path, size, modified) of every file under a folder; contents are not read.

    Scans leave empty files out; these come from the names that Spark lists
    on the driver for any scan, without a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    listed = files.select(
        F.col("_metadata.file_path").alias(SOURCE_FILE),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
    plain = [re.sub("^file:/+", "file:/", name) for name in files.inputFiles()]
    every = spark.createDataFrame([(name, unquote(name)) for name in plain], f"{SOURCE_FILE} string, path string")
    empty = every.join(listed, "path", "left_anti").select(
        SOURCE_FILE, "path", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("modified")
    )
    return listed.unionByName(empty)


class Landing:
    """A table of lines that mirrors folders of text files, and the manifest that says what is in it.

    Every landing appends the lines of new and changed files under its number,
    and then writes a manifest of all files with the landing that holds their
    lines. Lines that the newest manifest does not name are not in the table any
    more, so a landing that broke off leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, table_path: str) -> None:
        self.spark = spark
        self.lines_path, self.manifests_path = f"{table_path}/lines", f"{table_path}/manifests"

    def _newest(self) -> int:
        """Number of the last complete landing; 0 before the first."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.manifests_path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return 0
        done = [str(s.getPath()) for s in fs.listStatus(fs_path)]
        complete = [p for p in done if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
        return max((int(p.rsplit("=", 1)[1]) for p in complete), default=0)

    def manifest(self) -> DataFrame:
        """One row per file of the newest landing: what was found about it, and the landing that holds its lines."""
        newest = self._newest()
        if newest == 0:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.manifests_path}/manifest={newest}")

    def lines(self) -> DataFrame:
        """(value, source_file) of all files that are in the table."""
        schema = f"value string, {SOURCE_FILE} string, landing int"
        stored = self.spark.read.schema(schema).parquet(self.lines_path)
        held = self.manifest().where((F.col("status") != REMOVED) & (F.col("size") > 0)).select(SOURCE_FILE, "landing")
        # As many rows as the driver lists to read a folder; a shuffle would send all lines of a file to one task.
        return stored.join(F.broadcast(held), [SOURCE_FILE, "landing"], "left_semi").select("value", SOURCE_FILE)

    def land(self, source: str) -> DataFrame:
        """Bring the table to what is under ``source`` and return the manifest; files of other folders are left alone.

        Only new and changed files are read. A missing source or a failing write raises.
        """
        number = self._newest() + 1
        found = list_files(self.spark, source)
        # Its own folder decides what can have been removed.
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        root = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
        inside = F.startswith("path", F.lit(f"{root}/")) | (F.col("path") == root)
        known = self.manifest().where(F.col("status") != REMOVED).select(
            "path",
            F.col(SOURCE_FILE).alias("old_file"),
            F.col("size").alias("old_size"),
            F.col("modified").alias("old_modified"),
            F.col("landing").alias("held_by"),
        )
        same = (F.col("size") == F.col("old_size")) & ((F.col("size") == 0) | (F.col("modified") == F.col("old_modified")))
        status = (
            F.when(F.col("old_file").isNull(), NEW)
            .when(F.col(SOURCE_FILE).isNull(), F.when(inside, REMOVED).otherwise(UNCHANGED))
            .when(same, UNCHANGED)
            .when(F.col("size") == 0, EMPTIED)
            .otherwise(CHANGED)
        )
        kept = F.col("status").isin(UNCHANGED, REMOVED)
        files = found.join(known, "path", "full").withColumn("status", status).select(
            F.coalesce(SOURCE_FILE, "old_file").alias(SOURCE_FILE),
            "path",
            F.coalesce("size", "old_size").alias("size"),
            F.coalesce("modified", "old_modified").alias("modified"),
            "status",
            F.when(kept, F.col("held_by")).otherwise(number).cast("int").alias("landing"),
        )
        files = materialise(files, scratch_path(self.spark, "landing-files"))
        # Paths only, as many as Spark lists on the driver to read a folder.
        wanted = [r["path"] for r in files.where(F.col("status").isin(NEW, CHANGED) & (F.col("size") > 0)).select("path").collect()]
        schema = f"value string, {SOURCE_FILE} string"
        lines = self.spark.createDataFrame([], schema)
        if wanted:
            plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in wanted]
            lines = self.spark.read.text(plain).select("value", F.col("_metadata.file_path").alias(SOURCE_FILE))
        lines.write.mode("overwrite").parquet(f"{self.lines_path}/landing={number}")
        files.write.mode("overwrite").parquet(f"{self.manifests_path}/manifest={number}")
        return self.manifest()


def land_directory(spark: SparkSession, source: str, table_path: str) -> DataFrame:
    """Every line under ``source`` in a table, with the file it came from: landing again takes over what has changed."""
    landing = Landing(spark, table_path)
    landing.land(source)
    return landing.lines()
