import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from svmflow.operators.split import (
    cascade_schedule,
    class_counts,
    count_buckets,
    label_filter,
    line_class_counts,
    merge_pairs,
    place_groups,
    stratified_split,
    subset_balance,
    with_quotas,
)


def rows(spark, n, share=3):
    label = F.when(F.col("id") % share == 0, "+1").otherwise("-1")
    return spark.range(n).select(F.col("id").alias("row_id"), label.alias("label_text"))


@pytest.mark.parametrize(("total", "n"), [(100, 1), (100, 3), (997, 16), (5, 8)])
def test_balance_and_quotas(spark, total, n):
    split = stratified_split(rows(spark, total), n)
    sizes = {(r["subset_id"], r["label_text"]): r["n"] for r in subset_balance(split).collect()}
    assert sum(sizes.values()) == total
    quota = with_quotas(class_counts(rows(spark, total)), n).first()
    for label, most in (("+1", quota["max_class_1"]), ("-1", quota["max_class_2"])):
        per_subset = [sizes.get((k, label), 0) for k in range(n)]
        assert max(per_subset) - min(per_subset) <= 1
        assert max(per_subset) <= most


@settings(max_examples=200)
@given(total=st.integers(1, 10_000), n=st.integers(1, 64), share=st.floats(0.0, 1.0))
def test_dealing_in_turn_fits_the_quotas(total, n, share):
    first = round(total * share)
    most = math.ceil(total / n)
    most_first = math.ceil(most * (first / total))
    assert math.ceil(first / n) <= most_first
    assert math.ceil((total - first) / n) <= most - most_first + 1


def test_split_does_not_depend_on_partitioning(spark):
    base = None
    for parts, digits in ((1, 1), (4, 2), (8, 4)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            split = stratified_split(rows(spark, 500).repartition(parts), 4, seed=7, bucket_digits=digits)
            found = sorted((r["row_id"], r["subset_id"]) for r in split.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        base = base or found
        assert found == base
    for most, digits in ((5, 1), (1, 2), (1, 1)):
        # Buckets split again and again, down to single rows.
        split = stratified_split(rows(spark, 500), 4, seed=7, bucket_digits=digits, most_rows=most)
        assert sorted((r["row_id"], r["subset_id"]) for r in split.collect()) == base
    other = stratified_split(rows(spark, 500), 4, seed=8)
    assert sorted((r["row_id"], r["subset_id"]) for r in other.collect()) != base


def test_other_labels_are_dropped_and_counted(spark):
    lines = spark.createDataFrame([("+1 1:1",), ("-1 1:1",), ("0 1:1",), ("1 1:1",), ("+1",)], "value string")
    row = line_class_counts(lines).first()
    assert (row["total_records"], row["class_1"], row["class_2"], row["dropped"]) == (5, 1, 1, 3)
    labels = spark.createDataFrame([("+1",), ("-1",), ("0",), ("1",), (None,)], "label_text string")
    assert sorted(r[0] for r in label_filter(labels).collect()) == ["+1", "-1"]
    empty = with_quotas(class_counts(labels.where("false")), 2).first()
    assert empty["total_records"] == 0 and empty["max_class_1"] is None


def test_merge_pairs(spark):
    df = merge_pairs(spark.range(5).select(F.col("id").cast("int").alias("subset_id")))
    assert [r[0] for r in df.collect()] == [0, 0, 1, 1, 2]


def test_schedule(spark):
    df = spark.range(1, 70).select(F.col("id").alias("n"), F.inline(cascade_schedule(F.col("id"))))
    found = {}
    for row in df.orderBy("n", "layer").collect():
        found.setdefault(row["n"], []).append(row["n_subsets"])
    for n, layers in found.items():
        expected = [n]
        while expected[-1] > 1:
            expected.append((expected[-1] + 1) // 2)
        assert layers == expected, n


def test_groups_are_placed_evenly_without_a_second_shuffle(spark):
    df = spark.range(800).select((F.col("id") % 8).cast("int").alias("subset_id"))
    placed = place_groups(df, 8)
    per_task = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("subset_id").alias("n")).collect()
    assert [r["n"] for r in per_task] == [1] * 8
    grouped = placed.groupBy("_task", "subset_id").applyInArrow(lambda t: t.slice(0, 1), "subset_id int, _task int")
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_buckets_split_until_small(spark):
    kept = []
    write = lambda df: kept.append(df.cache()) or kept[-1]
    found = count_buckets(rows(spark, 2_000), write=write, bucket_digits=1, most_rows=20)
    assert found.digits == 2 and len(kept) == 2
    assert kept[0].agg(F.max("_n")).first()[0] > 20 >= found.sizes.agg(F.max("_n")).first()[0]
    starts = {(r["label_text"], r["_bucket"]): r["_start"] for r in found.starts("label_text").collect()}
    before = {}
    for r in found.sizes.orderBy("label_text", "_bucket").collect():
        assert starts[r["label_text"], r["_bucket"]] == before.get(r["label_text"], 0)
        before[r["label_text"]] = before.get(r["label_text"], 0) + r["_n"]
    copies = rows(spark, 1).crossJoin(spark.range(30).select(F.lit(1).alias("copy")))
    stuck = count_buckets(copies, write=lambda df: df, bucket_digits=5, most_rows=3)
    assert stuck.digits == 15, "rows of one id stay together"
    with pytest.raises(ValueError):
        count_buckets(rows(spark, 5), write=lambda df: df, bucket_digits=6)
