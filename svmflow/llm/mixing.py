"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, n_words, save

#: Hexadecimal digits of the draw key that form a bucket: rows of one source are ranked in 4096 parts.
BUCKET_DIGITS = 3


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Target size of every source from ``(source, source_size)``.

    ``share`` of the total size is dealt out by weight; weights repeat over the
    sources by code point, null last. A source that would pass ``max_epochs``
    of its size is clamped there and its excess goes to the others by weight,
    until none is above. Sources are visited by the level at which they clamp,
    so the feasible level is found in one pass over one row per source. Empty
    sources get 0; if everything clamps, the total falls short of ``share``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy("clamps_at", "position").rowsBetween
    unbounded = (Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sources.withColumn("position", F.row_number().over(by_name))
        .withColumn(
            "weight",
            F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("position") - 1) % len(weights) + 1),
        )
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("clamps_at", F.col("cap") / F.col("weight"))
    )
    levelled = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything(*unbounded)) * float(share))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(everything(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.col("clamped")) / F.col("open_weight"))
        .withColumn(
            "feasible",
            F.min(F.when(F.col("level") <= F.col("clamps_at"), F.struct("clamps_at", "position", "level"))).over(
                everything(*unbounded)
            )["level"],
        )
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("feasible"), F.lit(float("inf"))) * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def draw_key(id_col: str, size: Column, seed: str) -> Column:
    """A seeded order of the documents that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), size.cast("string")))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one plan row per source).

    A plan holds the whole repetitions that every document gets and the draw
    key up to which documents get one more. The key is found from the sizes of
    key buckets and the rows of the single bucket in which the goal is met, so
    no source is ever sorted in one task.
    """
    size = n_words(F.col("text"))
    sized = save(
        docs.select(F.col(id_col), F.col("source"), size.alias("size")).withColumn(
            "key", draw_key(id_col, F.col("size"), seed)
        ),
        "mix-sizes",
    )
    buckets = sized.groupBy("source", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")).agg(
        F.sum("size").alias("bucket_size")
    )
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = (
        water_fill(sources, weights, share, max_epochs)
        .withColumn("whole", F.floor(epochs))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    goals = save(goals, "mix-goals")
    to_here = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        buckets.withColumn("upto", F.sum("bucket_size").over(to_here))
        .withColumn("start", F.col("upto") - F.col("bucket_size"))
        .join(goals.select(F.col("source").alias("s"), "goal"), F.col("source").eqNullSafe(F.col("s")))
        .where("start <= goal and goal < upto")
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "start", "goal")).alias("edge"))
        .select("source", "edge.*")
    )
    in_order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of one key have one size; so many of them lie with their middle before the goal.
    first_fits = F.col("before") + F.col("size") / 2 <= F.col("goal")
    fitting = F.floor((F.col("goal") - F.col("before")) / F.nullif("size", F.lit(0)) - 0.5) + 1
    fitting = F.least("copies", F.greatest(F.lit(1), F.coalesce(fitting, "copies")))
    last = (
        sized.select("source", "size", "key")
        .join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .where(F.substring("key", 1, BUCKET_DIGITS) == F.col("bucket"))
        .groupBy("source", "bucket", "start", "goal", "key")
        .agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.sum("size").alias("key_size"))
        .withColumn("before", F.col("start") + F.coalesce(F.sum("key_size").over(in_order), F.lit(0)))
        .groupBy("source", "bucket")
        .agg(F.max(F.when(first_fits, F.struct("key", "copies", fitting.alias("fitting")))).alias("last"))
        .select(F.col("source").alias("s"), F.coalesce("last.key", "bucket").alias("last_key"), "last.copies", "last.fitting")
    )
    plan = goals.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", "last_key", "copies", "fitting"
    )
    return sized, save(plan, "mix-plan")


def _drawn(rows: DataFrame, plan: DataFrame, key: str, source: str, order: Sequence[str]) -> tuple[DataFrame, Column]:
    """(``rows`` with the columns of ``plan``, 1 for those drawn once more).

    Rows up to the last key are drawn. Where rows repeat with that key, only
    the first few of them are, by number; so only such rows are numbered.
    """
    joined = rows.join(plan, F.col(source).eqNullSafe(F.col("plan_source")))
    upto = F.when(F.col(key) <= F.col("last_key"), 1).otherwise(0)
    if not plan.where("copies > fitting").head(1):
        return joined, upto
    nth = fresh("nth")
    split = F.coalesce((F.col(key) == F.col("last_key")) & (F.col("copies") > F.col("fitting")), F.lit(False))
    numbered = joined.where(split).withColumn(nth, F.row_number().over(Window.partitionBy("plan_source").orderBy(*order)))
    rest = joined.where(~split).withColumn(nth, F.lit(0))
    return rest.unionByName(numbered), F.when(F.col(nth) > F.col("fitting"), 0).otherwise(upto)


def with_taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Each sized document with its source's plan and the words the mix takes of it."""
    rows, extra = _drawn(sized, plan.withColumnRenamed("source", "plan_source"), "key", "source", ["key"])
    return rows.withColumn("repeats", (F.col("whole") + extra).cast("int")).withColumn("taken", F.col("repeats") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: id, size, source_size, target of its source, and taken (words the mix takes, repeats counted).

    Documents are repeated whole: every one ``whole`` times, and those first in
    a seeded order once more until the source's words are nearest its target.
    A null text has size 0, a null source is a source of its own, of rows that
    repeat with one id and size some may be drawn and others not, an empty table gives no rows,
    and further columns are ignored.
    """
    id_col = options.get("id_col", "doc_id")
    return with_taken(*plan_mix(docs, **options)).select(id_col, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it; columns stay as they are.

    Empty documents count no words and stay in the mix once.
    """
    _, plan = plan_mix(docs, seed=seed, id_col=id_col, **options)
    named = {c: fresh(c) for c in ("key", "size", "repeat")}
    size = n_words(F.col("text"))
    rows = docs.withColumn(named["size"], size)
    rows = rows.withColumn(named["key"], draw_key(id_col, F.col(named["size"]), seed))
    # The plan's names may be those of columns of the documents.
    held = {c: fresh(c) for c in docs.columns}
    rows = rows.withColumnsRenamed(held)
    key, source = named["key"], held["source"]
    rows, extra = _drawn(rows, plan.withColumnRenamed("source", "plan_source"), key, source, [held["text"]])
    repeats = F.when(F.col(named["size"]) == 0, 1).otherwise(F.col("whole") + extra)
    repeated = rows.withColumn(named["repeat"], F.explode(F.array_repeat(F.lit(1), repeats.cast("int"))))
    return repeated.select(*(F.col(held[c]).alias(c) for c in docs.columns))
