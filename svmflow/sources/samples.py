"""Sparse labelled samples: ``label idx:val idx:val ...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.functions.parsing import (
    REJECT_REASON,
    compute_once,
    finish_parse,
    leading_token,
    token_pairs,
    tokens,
)


def parse_samples(lines: DataFrame, *, value: str = "value", mode: str = "quarantine") -> DataFrame:
    """Add ``label_text``, ``label``, ``features`` and ``reject_reason`` to text lines.

    ``label_text`` is the exact text before the first space, which training
    uses to pick its two classes; ``label`` is the first token as a number.
    Numbers that are not finite and indices that do not ascend are rejected.
    """
    toks = F.col("_tokens")
    split = compute_once(lines, _tokens=tokens(F.col(value)))
    numbered = compute_once(split, _numbers=toks.try_cast("array<double>"))
    parsed = compute_once(numbered, features=token_pairs(toks, F.col("_numbers"))).withColumn(
        "label", F.get("_numbers", F.lit(0))
    )
    bad_pair = F.exists("features", lambda f: f["idx"].isNull() | f["val"].isNull())
    not_finite = F.exists("features", lambda f: F.isnan(f["val"]) | (F.abs(f["val"]) == float("inf")))
    # Each index must be larger than the one before it: the last is then the largest, and none repeats.
    index = F.transform("features", lambda f: f["idx"])
    unordered = F.exists(
        F.arrays_zip(F.slice(index, 1, F.size(index) - 1).alias("a"), F.slice(index, 2, F.size(index)).alias("b")),
        lambda p: p["a"] >= p["b"],
    )
    label_not_finite = F.isnan("label") | (F.abs("label") == float("inf"))
    reason = (
        F.when(F.size(toks) == 0, "blank line")
        .when(F.col("label").isNull(), "bad label")
        .when(label_not_finite, "bad label")
        .when(bad_pair | not_finite, "bad feature")
        .when((F.size("features") > 1) & unordered, "unordered features")
    )
    out = (
        parsed.withColumn(REJECT_REASON, reason)
        .withColumn("label_text", leading_token(F.col(value)))
        .drop("_tokens", "_numbers")
    )
    return finish_parse(out, mode)


def samples_from_arrays(df: DataFrame, array_col: str) -> DataFrame:
    """Add ``features`` from a dense array column, with 1-based indices."""
    pairs = F.transform(
        array_col, lambda v, i: F.struct((i + 1).alias("idx"), v.cast("double").alias("val"))
    )
    return df.withColumn("features", pairs)


def feature_text() -> Column:
    """``idx:val idx:val ...`` for the ``features`` column."""
    return F.array_join(
        F.transform("features", lambda f: F.concat(f["idx"].cast("string"), F.lit(":"), f["val"].cast("string"))), " "
    )
