"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.session import materialise, scratch_path

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and continue from it."""
    return materialise(df, scratch_path(df.sparkSession, name))


def fresh(name: str) -> str:
    """A column name that no input column carries."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def tables_in(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of a data folder."""
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def id_order(columns: Iterable[str]) -> list[Column]:
    """An order over the given columns in which nulls come last."""
    return [F.col(c).asc_nulls_last() for c in columns]
