"""Class counts and the stratified split of training data into subsets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svmflow.functions.parsing import leading_token
from svmflow.session import materialise, scratch_path

# The exact label texts of the two training classes.
POSITIVE = "+1"
NEGATIVE = "-1"


def label_filter(df: DataFrame, *, label_text: str = "label_text") -> DataFrame:
    """Rows of the two training classes; other labels are dropped."""
    return df.where(F.col(label_text).isin(POSITIVE, NEGATIVE))


def class_counts(df: DataFrame, *, label_text: str = "label_text") -> DataFrame:
    """Total, per-class and dropped row counts in one row."""
    label = F.col(label_text)
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(label == POSITIVE).alias("class_1"),
        F.count_if(label == NEGATIVE).alias("class_2"),
        F.count_if(label.isNull() | ~label.isin(POSITIVE, NEGATIVE)).alias("dropped"),
    )


def line_class_counts(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """``class_counts`` straight from text lines."""
    return class_counts(lines.select(leading_token(F.col(value)).alias("label_text")))


def with_quotas(counts: DataFrame, n_subsets: int) -> DataFrame:
    """Largest number of rows a subset may take, in all and per class."""
    total = F.col("total_records")
    most = F.ceil(total / F.lit(float(n_subsets)))
    first = F.ceil(most * F.try_divide("class_1", total))
    return (
        counts.withColumn("max_records", most)
        .withColumn("max_class_1", first)
        .withColumn("max_class_2", F.col("max_records") - F.col("max_class_1") + 1)
    )


# Hex digits of the order key that name a bucket, first and with each refinement; rows of a bucket that need no other.
BUCKET_DIGITS = 4
MOST_BUCKET_ROWS = 100_000
# Digits that fit a bigint.
_MOST_DIGITS = 15


def _order_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def _bucket(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Buckets:
    """Rows per class and hash bucket (``_n``, and further aggregates), the digits that name a bucket, and their step."""

    sizes: DataFrame
    digits: int
    step: int

    def starts(self, label: str) -> DataFrame:
        """Rows of the class before each bucket.

        Summed level by level: no window holds more buckets than the digits of one step allow.
        """
        return _starts(self.sizes.select(label, "_bucket", "_n"), label, self.digits, self.step)


def _starts(sizes: DataFrame, label: str, digits: int, step: int) -> DataFrame:
    def before(*keys: str) -> Column:
        window = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    if digits <= step:
        return sizes.select(label, "_bucket", before(label).alias("_start"))
    lower = sizes.withColumn("_upper", F.shiftright("_bucket", 4 * step))
    upper = lower.groupBy(label, F.col("_upper").alias("_bucket")).agg(F.sum("_n").alias("_n"))
    upper = _starts(upper, label, digits - step, step).withColumnsRenamed({"_bucket": "_upper", "_start": "_above"})
    inside = lower.withColumn("_inside", before(label, "_upper"))
    return inside.join(upper, [label, "_upper"]).select(label, "_bucket", (F.col("_above") + F.col("_inside")).alias("_start"))


def count_buckets(
    df: DataFrame,
    *extra: Column,
    write: Callable[[DataFrame], DataFrame],
    row_id: str = "row_id",
    label: str = "label_text",
    seed: int = 0,
    bucket_digits: int = BUCKET_DIGITS,
    most_rows: int = MOST_BUCKET_ROWS,
) -> Buckets:
    """Buckets of a class by its hashed order, split again until none holds more than ``most_rows`` rows.

    Each refinement is another pass over the rows, which only very large
    classes need. ``extra`` aggregates are taken in the same pass; ``write`` keeps the table.
    Rows of one id cannot be told apart, so a bucket of them ends the search at the digits a bigint holds.
    """
    if not 1 <= bucket_digits <= 5:
        raise ValueError("bucket_digits must be 1..5: a window over buckets holds up to 16**digits rows")
    digits = bucket_digits
    while True:
        keyed = df.withColumn("_bucket", _bucket(_order_key(row_id, seed), digits))
        sizes = write(keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"), *extra))
        most = sizes.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
        if most <= most_rows or digits + bucket_digits > _MOST_DIGITS:
            return Buckets(sizes, digits, bucket_digits)
        digits += bucket_digits


def stratified_split(
    df: DataFrame,
    n_subsets: int | Column,
    *,
    row_id: str = "row_id",
    label: str = "label_text",
    seed: int = 0,
    bucket_digits: int = BUCKET_DIGITS,
    most_rows: int = MOST_BUCKET_ROWS,
    buckets: Buckets | None = None,
) -> DataFrame:
    """Deal the rows of each class evenly over ``n_subsets`` in a seeded random order.

    Adds ``subset_id`` in 0..n-1; per class the subset sizes differ by at most
    one row. The order is the md5 of seed and row id, so the result does not
    depend on partitioning. A row's exact rank in its class is its rank inside
    a hash bucket plus the sizes of the buckets before it. The window sorts
    within buckets only, and buckets are as small as ``most_rows`` asks: a class never passes through one task, however large
    its share of the rows.
    Row ids must be unique and labels not null. ``buckets`` takes what ``count_buckets`` has found
    and saves a pass over the rows.
    """
    if buckets is None:
        write = lambda sizes: materialise(sizes, scratch_path(df.sparkSession, "bucket-sizes"))
        buckets = count_buckets(
            df, write=write, row_id=row_id, label=label, seed=seed, bucket_digits=bucket_digits, most_rows=most_rows
        )
    # The bucket comes first: an integer that tells most rows apart makes the sort cheap.
    in_bucket = Window.partitionBy("_bucket", label).orderBy("_order", row_id)
    ranked = (
        df.withColumn("_order", _order_key(row_id, seed))
        .withColumn("_bucket", _bucket(F.col("_order"), buckets.digits))
        .withColumn("_place", F.row_number().over(in_bucket) - 1)
    )
    n = F.lit(n_subsets) if isinstance(n_subsets, int) else n_subsets
    # Every bucket has a start; the outer join only spares the null checks an inner join would add.
    return (
        ranked.join(buckets.starts(label), ["_bucket", label], "left")
        .withColumn("subset_id", ((F.col("_start") + F.col("_place")) % n).cast("int"))
        .drop("_order", "_bucket", "_place", "_start")
        .select(*df.columns, "subset_id")
    )


TASK = "_task"
# Groups that one task takes at most; more groups mean more tasks, whatever the settings.
GROUPS_PER_TASK = 16


def place_groups(df: DataFrame, n_groups: int, group_no: Column | None = None) -> DataFrame:
    """Shuffle so that groups are dealt evenly over tasks; adds the task number as ``_task``.

    A group gets a task of its own up to the shuffle-partition setting, beyond
    it every task gets the same number of groups, ``GROUPS_PER_TASK`` at most;
    the number of tasks so follows the data. The placement is explicit,
    so neither hash collisions nor runtime coalescing (which sees bytes, not
    training time) can queue groups behind each other. Grouping by ``_task``
    and the group's own key afterwards needs no further shuffle.
    """
    spark = df.sparkSession
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(setting, spark.sparkContext.defaultParallelism, -(-n_groups // GROUPS_PER_TASK))
    n_tasks = max(1, min(n_groups, wanted))
    number = F.col("subset_id") if group_no is None else group_no
    return df.withColumn(TASK, F.pmod(number, F.lit(n_tasks)).cast("int")).repartitionById(n_tasks, F.col(TASK))


def subset_balance(subsets: DataFrame, *, label: str = "label_text") -> DataFrame:
    """Rows per subset and class."""
    return subsets.groupBy("subset_id", label).agg(F.count("*").alias("n"))


def merge_pairs(subsets: DataFrame) -> DataFrame:
    """Put subsets 2k and 2k+1 together as subset k."""
    return subsets.withColumn("subset_id", F.expr("subset_id div 2").cast("int"))


def cascade_schedule(n_subsets: Column) -> Column:
    """Array of (layer, n_subsets), halving (rounded up) until one subset is left."""
    # Bits of n-1: an exact ceil(log2 n).
    n_layers = F.when(n_subsets > 1, F.length(F.bin(n_subsets.cast("bigint") - 1))).otherwise(0)
    return F.transform(
        F.sequence(F.lit(0), n_layers),
        lambda i: F.struct(
            (i + 1).alias("layer"),
            F.ceil(n_subsets / F.pow(F.lit(2.0), i)).cast("int").alias("n_subsets"),
        ),
    )
