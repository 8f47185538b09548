"""Dense labelled points: ``y x0 x1 ... x9`` separated by single spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.functions.parsing import REJECT_REASON, compute_once, finish_parse

# Fixed value: number of dimensions of a dense point.
DIMS = 10


def parse_points(
    lines: DataFrame, *, dims: int = DIMS, value: str = "value", mode: str = "quarantine"
) -> DataFrame:
    """Add ``y`` and ``x`` (array of ``dims`` doubles); tokens beyond ``dims`` are ignored."""
    toks = F.col("_tokens")
    number = [F.get(toks, F.lit(i)).try_cast("double") for i in range(dims + 1)]
    split = compute_once(lines, _tokens=F.split(value, " "))
    parsed = compute_once(split, y=number[0], x=F.array(*number[1:]))
    # Every element is checked by name, not with a lambda, to stay inside codegen.
    complete = F.col("y").isNotNull()
    for i in range(dims):
        complete = complete & F.col("x")[i].isNotNull()
    reason = F.when(F.size(toks) <= dims, "too few fields").when(~complete, "bad number")
    return finish_parse(parsed.withColumn(REJECT_REASON, reason).drop("_tokens"), mode)
