"""Column expressions for turning delimited text into typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that separate tokens in a sample line.
SAMPLE_SEPARATORS = r"[ \t\n\r\f:]+"

FEATURES_TYPE = "array<struct<idx:int,val:double>>"

REJECT_REASON = "reject_reason"


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A plain projection would be copied into every filter on its output, and
    inside lambdas evaluated again per element; predicates do not move below
    a generator, so the expressions run once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def tokens(line: Column) -> Column:
    """Non-empty tokens of a sample line."""
    return F.array_remove(F.split(line, SAMPLE_SEPARATORS), "")


def leading_token(line: Column) -> Column:
    """Text before the first space; null when the line has no space."""
    return F.when(F.instr(line, " ") > 0, F.substring_index(line, " ", 1))


def token_pairs(toks: Column, numbers: Column) -> Column:
    """(idx, val) pairs from tokens 1.. of a sample line; an odd last token is dropped.

    ``numbers`` is the token array cast to doubles as a whole, which runs in
    generated code; only the index is cast inside the lambda.
    """

    def pair(i: Column) -> Column:
        return F.struct(toks[i].try_cast("int").alias("idx"), numbers[i + 1].alias("val"))

    first_of_pairs = F.sequence(F.lit(1), F.size(toks) - 2, F.lit(2))
    return F.when(F.size(toks) >= 3, F.transform(first_of_pairs, pair)).otherwise(F.array().cast(FEATURES_TYPE))


def finish_parse(df: DataFrame, mode: str) -> DataFrame:
    """Apply the bad-row policy to a frame that carries ``reject_reason``.

    ``quarantine`` keeps bad rows with their reason, ``strict`` fails the job
    on the first bad row, which is what the reference jobs do.
    """
    if mode == "quarantine":
        return df
    if mode != "strict":
        raise ValueError(f"mode must be 'quarantine' or 'strict', not {mode!r}")
    reason = F.col(REJECT_REASON)
    checked = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("malformed row: "), reason)).cast("string"))
    return df.withColumn(REJECT_REASON, checked).where(F.col(REJECT_REASON).isNull())


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col(REJECT_REASON).isNull()).drop(REJECT_REASON)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col(REJECT_REASON).isNotNull())
