"""Access-log roll-up by client, user and request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.sources.access_log import parse_log


def log_rollup(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Requests and bytes per (ip, user, query); unusable lines share the null key.

    ``bad_bytes`` counts matched lines whose byte field is no number; they add
    0 to ``bytes``. The null key can be most of a log: partial aggregation
    reduces it to one row per task before the shuffle.
    """
    return (
        parse_log(lines.select(value), value=value)
        .groupBy("ip", "user", "query")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"),
            F.count_if(F.col("bytes").isNull()).alias("bad_bytes"),
        )
    )
