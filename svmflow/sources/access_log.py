"""Web access log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svmflow.functions.parsing import compute_once

# The log pattern (groups 1 ip, 3 user, 5 request, 7 bytes) and
# the two built-in sample lines.
LOG_PATTERN = (
    r'^([\d.]+) (\S+) (\S+) \[([\w\d:/]+\s[+\-]\d{4})\] "(.+?)" (\d{3}) ([\d\-]+) "([^"]+)" "([^"]+)".*'
)
SAMPLE_LINES = [
    '10.10.10.10 - "FRED" [18/Jan/2013:17:56:07 +1100] "GET http://images.com/2013/Generic.jpg '
    'HTTP/1.1" 304 315 "http://referall.com/" "Mozilla/4.0 (compatible; MSIE 7.0; '
    "Windows NT 5.1; GTB7.4; .NET CLR 2.0.50727; .NET CLR 3.0.04506.30; .NET CLR 3.0.04506.648; "
    ".NET CLR 3.5.21022; .NET CLR 3.0.4506.2152; .NET CLR 1.0.3705; .NET CLR 1.1.4322; .NET CLR "
    '3.5.30729; Release=ARP)" "UD-1" - "image/jpeg" "whatever" 0.350 "-" - "" 265 923 934 "" '
    "62.24.11.25 images.com 1358492167 - Whatup",
    '10.10.10.10 - "FRED" [18/Jan/2013:18:02:37 +1100] "GET http://images.com/2013/Generic.jpg '
    'HTTP/1.1" 304 306 "http:/referall.com" "Mozilla/4.0 (compatible; MSIE 7.0; Windows NT 5.1; '
    "GTB7.4; .NET CLR 2.0.50727; .NET CLR 3.0.04506.30; .NET CLR 3.0.04506.648; .NET CLR "
    "3.5.21022; .NET CLR 3.0.4506.2152; .NET CLR 1.0.3705; .NET CLR 1.1.4322; .NET CLR  "
    '3.5.30729; Release=ARP)" "UD-1" - "image/jpeg" "whatever" 0.352 "-" - "" 256 977 988 "" '
    "0 73.23.2.15 images.com 1358492557 - Whatup",
]

# A matched line is rewritten to MARK ip bytes user request. The first three
# hold no blank, so one split with a limit takes the line apart, and the
# pattern runs once per line instead of once per group.
_MARK = "\x01"
_REWRITE = f"{_MARK}$1 $7 $3 $5"
_WHOLE_LINE = LOG_PATTERN.removesuffix(".*") + r"(?s:.*)"


def sample_lines(spark: SparkSession) -> DataFrame:
    """The built-in log lines, used when no log is given."""
    return spark.createDataFrame([(line,) for line in SAMPLE_LINES], "value string")


def parse_log(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Add ``matched``, ``ip``, ``user``, ``query`` and ``bytes``.

    The key columns are null unless the line matches and has a user other than
    ``-``. ``bytes`` is 0 for a line that does not match and null where a
    matched line has no readable number.
    """
    parts = F.col("_parts")
    hit = F.col("matched")
    keyed = hit & (F.lower(F.get(parts, F.lit(2))) != "-")
    return (
        compute_once(lines, _rewritten=F.regexp_replace(value, _WHOLE_LINE, _REWRITE))
        # A line that starts with the mark by itself cannot match the pattern.
        .withColumn(
            "matched", F.coalesce(F.startswith("_rewritten", F.lit(_MARK)) & ~F.startswith(value, F.lit(_MARK)), F.lit(False))
        )
        .withColumn("_parts", F.when(hit, F.split(F.substring("_rewritten", 2, 2**31 - 1), " ", 4)))
        .withColumn("ip", F.when(keyed, F.get(parts, F.lit(0))))
        .withColumn("user", F.when(keyed, F.get(parts, F.lit(2))))
        .withColumn("query", F.when(keyed, F.get(parts, F.lit(3))))
        .withColumn("bytes", F.when(hit, F.get(parts, F.lit(1)).try_cast("bigint")).otherwise(F.lit(0)))
        .drop("_rewritten", "_parts")
    )
