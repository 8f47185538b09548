"""Ratings: ``user::movie::rating::timestamp``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.functions.parsing import REJECT_REASON, compute_once, finish_parse

# Field separator and field count of a rating line.
SEPARATOR = "::"
N_FIELDS = 4


def parse_ratings(lines: DataFrame, *, value: str = "value", mode: str = "quarantine") -> DataFrame:
    """Add ``user_id``, ``movie_id``, ``rating``, ``ts`` and ``reject_reason``.

    Exactly four fields are required. Empty fields at the end of a line do not
    count as fields, so ``1::2::3::4::`` is good and ``1::2::3::`` is not.
    """
    f = F.col("_fields")
    parsed = compute_once(
        compute_once(lines, _fields=F.split(value, SEPARATOR)),
        user_id=F.get(f, F.lit(0)).try_cast("int"),
        movie_id=F.get(f, F.lit(1)).try_cast("int"),
        rating=F.get(f, F.lit(2)).try_cast("float"),
        ts=F.get(f, F.lit(3)).try_cast("bigint"),
    )
    beyond = F.array_join(F.slice(f, N_FIELDS + 1, F.greatest(F.size(f) - N_FIELDS, F.lit(0))), "")
    four_fields = (F.size(f) >= N_FIELDS) & (F.get(f, F.lit(N_FIELDS - 1)) != "") & (beyond == "")
    any_null = (
        F.col("user_id").isNull() | F.col("movie_id").isNull() | F.col("rating").isNull() | F.col("ts").isNull()
    )
    reason = F.when(~four_fields, "not 4 fields").when(any_null, "bad number")
    return finish_parse(parsed.withColumn(REJECT_REASON, reason).drop("_fields"), mode)
