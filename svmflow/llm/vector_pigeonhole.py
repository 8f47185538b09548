"""Near-duplicate vectors by a pigeonhole join over blocks of rotated coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import fresh, save
from svmflow.llm.components import components

#: Blocks that the rotated coordinates are split into.
BLOCKS = 8
#: Rows of one side of a join task; a fuller cell is joined in pairs of chunks.
CHUNK_ROWS = 16_384
#: Rows against all of the other side in one matrix product, and pairs verified at once.
STRIP_ROWS, VERIFY_PAIRS = 1_024, 50_000
#: Slack for rounding, far below any distance that matters and far above the error.
SLACK = 1e-9


def rotate(unit: np.ndarray) -> np.ndarray:
    """A fixed random rotation: signs, then a Hadamard transform, over the next power of two of dimensions.

    Only element-wise operations, so a vector gets the same bits in any batch.
    """
    n, dims = unit.shape
    width = 1 << max(0, (dims - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :dims] = unit
    rng = np.random.default_rng(12_345)
    for _ in range(2):
        out *= rng.integers(0, 2, width) * 2.0 - 1.0
        step = 1
        while step < width:
            pairs = out.reshape(n, width // (2 * step), 2, step)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
            step *= 2
        out /= math.sqrt(width)
    return out


def block_bounds(width: int) -> list[tuple[int, int]]:
    """Column ranges of the blocks; fewer blocks than ``BLOCKS`` when there are fewer columns."""
    cuts = np.linspace(0, width, min(BLOCKS, width) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _cells(block: np.ndarray, splits: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row numbers, cell, is home): the home cell of each row, and lower cells that its ball reaches.

    A cell is the sign pattern of the first ``splits`` coordinates. A cell
    other than home is within reach if the squared distances to the crossed
    planes add up to at most ``reach``. Only cells below home are probed, as a
    pair in two cells meets in the lower one.
    """
    splits = min(splits, block.shape[1])
    lead = block[:, :splits]
    bits = 1 << np.arange(splits)
    home = (lead >= 0) @ bits
    rows = np.arange(len(block))
    yield rows, home, True
    squares = lead * lead
    for flip in range(1, 1 << splits):
        crossed = (flip & bits) > 0
        other = home ^ flip
        hit = (squares[:, crossed].sum(axis=1) <= reach) & (other < home)
        if hit.any():
            yield rows[hit], other[hit], False


def _place(splits: int, budget: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["dims"])
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                turned = rotate(unit_rows(_matrix(part["vec"])))
                bounds = block_bounds(turned.shape[1])
                for b, (lo, hi) in enumerate(bounds):
                    reach = budget * (hi - lo) / turned.shape[1] * (1 + SLACK) + SLACK
                    for rows, cell, home in _cells(turned[:, lo:hi], splits, reach):
                        taken = part.take(pa.array(rows))
                        yield pa.record_batch(
                            {
                                "dims": taken["dims"],
                                "block": pa.array(np.full(len(rows), b, np.int32)),
                                "cell": pa.array(cell.astype(np.int32)),
                                "home": pa.array(np.full(len(rows), home)),
                                "uid": taken["uid"],
                                "weight": taken["weight"],
                                "vec": taken["vec"],
                            }
                        )

    return run


class _Forest:
    """Union of positions, kept as flat as pairs arrive."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            np.minimum.at(self.root, high, low)
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def _join(threshold: float):
    budget = 2.0 - 2.0 * threshold

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, kind, i_chunk, j_chunk = (key[k].as_py() for k in (1, 3, 4, 5))
        within = kind == 0 and i_chunk == j_chunk
        sides = np.asarray(table["side"].combine_chunks())
        order = np.argsort(sides, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        sides = sides[order]
        unit = unit_rows(_matrix(table["vec"].chunk(0)))
        turned = rotate(unit)
        bounds = block_bounds(turned.shape[1])
        weight, uid = np.asarray(table["weight"].chunk(0)), np.asarray(table["uid"].chunk(0))
        n_left = int((sides == 0).sum())
        lo, hi = bounds[block]
        own = turned[:, lo:hi]
        square = np.einsum("ij,ij->i", own, own)
        links, forest = np.zeros(len(uid), np.int64), _Forest(len(uid))

        def verify(a: np.ndarray, b: np.ndarray) -> None:
            for at in range(0, len(a), VERIFY_PAIRS):
                i, j = a[at : at + VERIFY_PAIRS], b[at : at + VERIFY_PAIRS]
                # A pair counts in the first block that it meets in.
                for nth, (x, y) in enumerate(bounds[: block + 1]):
                    gap = turned[i, x:y] - turned[j, x:y]
                    near = (gap * gap).sum(axis=1) <= budget * (y - x) / turned.shape[1] * (1 + SLACK)
                    keep = near if nth == block else ~near
                    i, j = i[keep], j[keep]
                close = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[close], j[close]
                if len(i):
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    forest.join(i, j)

        reach = budget * (hi - lo) / turned.shape[1] * (1 + SLACK) + SLACK
        # Side 0 is a chunk of the cell's own rows; it meets the rows after it, and itself where the task says so.
        for at in range(0, n_left, STRIP_ROWS):
            to = min(at + STRIP_ROWS, n_left)
            first = at if within else n_left
            gap = square[at:to, None] + square[None, first:] - 2.0 * (own[at:to] @ own[first:].T)
            i, j = np.nonzero(gap <= reach)
            i, j = i + at, j + first
            if within:
                ordered = i < j
                i, j = i[ordered], j[ordered]
            verify(i, j)
        linked = np.flatnonzero(links)
        return pa.table({"uid": uid[linked], "links": links[linked], "root": uid[forest.root[linked]]})

    return run


def _finite(vec: Column) -> Column:
    return ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, is at
    least ``threshold``. Unit vectors that close differ by at most 2 - 2 *
    threshold in squared distance, so in one block of the rotated coordinates
    they differ by at most the block's share; every block is range-joined under
    its share and each pair that meets is verified on the whole vectors. No
    link is lost whatever the data.

    Equal vectors are joined once and counted by weight. Tasks add up links and
    return one row per linked vector with the root of its tree, never pairs.
    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, and so does a row without id (its component is null,
    kept is false). Vectors of different length do not link; repeated rows are
    rows like others; an empty table gives no rows.
    """
    key, uid = fresh("vec"), fresh("uid")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    usable = (
        F.col("id").isNotNull() & (F.size("vec") > 0) & _finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    reps = save(
        rows.where(usable)
        .groupBy("vec")
        .agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        .withColumn("dims", F.size("vec"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "vec-reps",
    )
    n = reps.count()
    splits = max(1, math.ceil(math.log2(max(n, 1) / (CHUNK_ROWS / 2)))) if n else 1
    budget = 2.0 - 2.0 * threshold
    vec_type = reps.schema["vec"].dataType.simpleString()
    placed = save(
        reps.select("uid", "weight", "dims", "vec").mapInArrow(
            _place(min(splits, 8), budget),
            f"dims int, block int, cell int, home boolean, uid long, weight long, vec {vec_type}",
        ),
        "vec-cells",
    )
    # At most blocks x 2^splits rows for each vector length.
    chunks = placed.groupBy("dims", "block", "cell").agg(
        F.ceil(F.sum(F.when(F.col("home"), 1).otherwise(0)) / CHUNK_ROWS).cast("int").alias("homes"),
        F.ceil(F.sum(F.when(F.col("home"), 0).otherwise(1)) / CHUNK_ROWS).cast("int").alias("guests"),
    )
    mine = F.pmod(F.xxhash64("uid"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    # Task (i, 0, j): home chunk i with home chunk j >= i; with a single guest chunk that joins task (i, 0, i).
    # Task (i, 1, j): home chunk i with guest chunk j.
    every = lambda of: F.sequence(F.lit(0), of - 1)
    home_tasks = F.concat(
        F.transform(every(F.col("homes")), lambda j: F.struct(
            F.least("mine", j).alias("i"), F.lit(0).alias("kind"), F.greatest("mine", j).alias("j"),
            F.when(j < F.col("mine"), 2).otherwise(0).alias("side"))),
        F.when(F.col("guests") > 1, F.transform(every(F.col("guests")), lambda j: F.struct(
            F.col("mine").alias("i"), F.lit(1).alias("kind"), j.alias("j"), F.lit(0).alias("side")))).otherwise(
            F.array().cast("array<struct<i:int,kind:int,j:int,side:int>>")),
    )
    guest_tasks = F.transform(every(F.col("homes")), lambda i: F.struct(
        i.alias("i"),
        F.when(F.col("guests") > 1, 1).otherwise(0).alias("kind"),
        F.when(F.col("guests") > 1, F.col("mine")).otherwise(i).alias("j"),
        F.lit(1).alias("side")))
    found = save(
        placed.join(F.broadcast(chunks), ["dims", "block", "cell"])
        .where("homes > 0")
        .withColumn("mine", mine)
        .withColumn("task", F.explode(F.when(F.col("home"), home_tasks).otherwise(guest_tasks)))
        .select("dims", "block", "cell", "task.kind", "task.i", "task.j", "task.side", "uid", "weight", "vec")
        .groupBy("dims", "block", "cell", "kind", "i", "j")
        .applyInArrow(_join(threshold), "uid long, links long, root long"),
        "vec-links",
    )
    counted = found.groupBy("uid").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
    named = (
        reps.join(counted, "uid", "left")
        .join(of, "uid", "left")
        .withColumn("component", F.coalesce("component", "uid"))
        .select("vec", "id", "weight", "links", "component")
    )
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    of_vec = named.join(least, "component").select(
        F.col("vec").alias(key), "weight", F.coalesce("links", F.lit(0)).alias(uid), "least"
    )
    joined = rows.withColumn(key, F.when(usable, F.col("vec"))).drop("vec").join(of_vec, key, "left")
    component = F.coalesce("least", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("weight") - 1 + F.col(uid), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
