"""Shards of near equal bytes from indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save

#: Items that one differencing task takes; beyond it, items are first differenced into bundles.
TASK_ITEMS = 20_000
#: Bundles that a task makes of its items.
BUNDLES = 64
#: A group of at least this part of a shard stays a single item up to the last step.
LARGE_PART = 64
#: Rows that one numbering task takes on average.
SLOT_ROWS = 50_000


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each item by the largest differencing method.

    Each item starts as a partial partition with one filled part. The two
    partial partitions with the largest spread are combined, the fullest part
    of one with the emptiest of the other, until one partition is left. Ties
    go by position, so equal input gives equal output.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    parent = np.arange(n)
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(parts, np.int64)
        nodes = np.full(parts, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-int(size), i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        b, b_nodes = b[::-1], b_nodes[::-1]
        both = (a_nodes >= 0) & (b_nodes >= 0)
        parent[b_nodes[both]] = a_nodes[both]
        nodes = np.where(a_nodes >= 0, a_nodes, b_nodes)
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, nodes))
        serial += 1
    while True:
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    part_of = np.zeros(n, np.int64)
    final = heap[0][3]
    part_of[final[final >= 0]] = np.flatnonzero(final >= 0)
    return part_of[parent]


def _differencer(parts: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        part = difference(items["bytes"].to_numpy(), parts)
        return pd.DataFrame({"item": items["item"], "bytes": items["bytes"], "part": key[0] * parts + part})

    return run


def assign(items: DataFrame, shards: int) -> DataFrame:
    """(item, shard) of every ``(item string, bytes long)`` with distinct items.

    While there are more items than a task takes, they are dealt to tasks by
    hash and differenced into bundles, which are the items of the next level;
    items so large that a shard must be built around them skip the levels. Every
    level divides the number of items by about 300, and each task stays bounded.
    """
    spark = items.sparkSession
    levels: list[DataFrame] = []
    current = save(items, "shard-items")
    # So many items can be large at most: half of what the last step takes.
    most_large = max(1, min(shards * LARGE_PART, TASK_ITEMS // 2))
    before = math.inf
    while True:
        n, total = current.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        if n <= TASK_ITEMS or n >= before:
            break
        before = n
        large = math.ceil(total / most_large)
        tasks = math.ceil(n / TASK_ITEMS)
        schema = "item string, bytes long, part long"
        small = current.where(F.col("bytes") < large).withColumn(
            "task", F.pmod(F.xxhash64("item"), F.lit(tasks)).cast("long")
        )
        bundled = save(
            small.groupBy("task")
            .applyInPandas(_differencer(BUNDLES), schema)
            .select("item", "bytes", F.concat(F.lit(f"{len(levels)}:"), F.col("part").cast("string")).alias("bundle")),
            "shard-level",
        )
        levels.append(bundled)
        next_items = bundled.groupBy(F.col("bundle").alias("item")).agg(F.sum("bytes").alias("bytes"))
        current = save(current.where(F.col("bytes") >= large).union(next_items), "shard-items")
    if n == 0:
        return spark.createDataFrame([], "item string, shard int")
    placed = save(
        current.withColumn("task", F.lit(0).cast("long"))
        .groupBy("task")
        .applyInPandas(_differencer(shards), "item string, bytes long, part long")
        .select("item", F.col("part").cast("int").alias("shard")),
        "shard-placed",
    )
    for level in reversed(levels):
        below = level.join(placed.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
        placed = save(placed.union(below), "shard-placed")
    return placed


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` (or the columns in ``keep``) with size, text_crc32, law, shard, slot and grown_shard.

    Documents with equal texts are one group and share a shard; null texts form
    one group. Shards are as equal in bytes as whole groups allow. ``slot``
    numbers the rows of a shard from 0 without gaps, by hash of the id. A null
    id is allowed; repeated rows are kept and numbered in any order; an empty
    table gives no rows. Input columns named like an output column are replaced.
    """
    group, bucket, first = fresh("group"), fresh("bucket"), fresh("first")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in (keep or docs.columns) if c not in made]
    marked = save(
        docs.select(
            *(F.col(f"`{c}`") for c in kept),
            text_size(F.col("text")).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias(group),
        ),
        "shard-rows",
    )
    groups = marked.groupBy(F.col(group).alias("item")).agg(F.sum("size").alias("bytes"))
    placed = assign(groups, shards)
    tasks = max(1, math.ceil(marked.count() / (SLOT_ROWS * shards)))
    located = (
        marked.join(placed.withColumnRenamed("item", group), group)
        .drop(group)
        .withColumn(bucket, F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32")), F.lit(tasks)))
    )
    counts = located.groupBy("shard", bucket).agg(F.count("*").alias(first))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bucket, F.coalesce(F.sum(first).over(earlier), F.lit(0)).alias(first))
    within = Window.partitionBy("shard", bucket).orderBy(F.col(id_col).asc_nulls_last(), "text_crc32")
    return (
        located.join(starts, ["shard", bucket])
        .withColumn("slot", F.col(first) + F.row_number().over(within) - 1)
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*(F.col(f"`{c}`") for c in kept), *made)
    )

